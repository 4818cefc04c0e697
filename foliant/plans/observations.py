"""Queries on observations and write evidence: captures rendered by SQL that both engines read, with a fault in most files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import observations
from .exports import _elements
from .registry import query

BAL = "cast(cast(abs(c_acctbal) as decimal(18,2)) as string)"
S = "cast({} as string)".format
GSTIN = "concat('27ABCDE', lpad(cast(k % 10000 as string), 4, '0'), 'F1Z5')"

REGISTRATION = f"concat('<TAXREGISTRATION OWNERKIND=\"LEDGER\" OWNERGUID=\"L', {S('k')}, '\"><REGISTRATIONTYPE>Regular</REGISTRATIONTYPE><GSTIN>', case when fault = 6 then 'none' else {GSTIN} end, '</GSTIN></TAXREGISTRATION>')"
LINE = f"concat('<VOUCHERTAX', case when fault = 7 then '' else concat(' VOUCHERGUID=\"V', {S('k')}, '\"') end, ' TAXROWORDINAL=\"', {S('k % 4')}, '\"><PLACEOFSUPPLY>Pune</PLACEOFSUPPLY><ASSESSABLEVALUE>', {BAL}, '</ASSESSABLEVALUE><TAXCOMPONENT>IGST</TAXCOMPONENT><TAXRATE>18</TAXRATE><TAXAMOUNT>-0.18</TAXAMOUNT></VOUCHERTAX>')"
ALLOCATION = f"concat('<BILLALLOCATION ORIGIN=\"', case when k % 4 = 1 then 'LEDGEROPENING\"' else concat('VOUCHER\" VOUCHERIDENTITY=\"V', {S('k')}, '\"', case when fault = 6 then '' else ' PARTYENTRYORDINAL=\"1\"' end) end, ' ROWORDINAL=\"', {S('k % 10 + 1')}, '\" REFERENCEKIND=\"', case k % 3 when 0 then 'New Ref\" REFERENCENAME=\"R' when 1 then 'On Account' else 'Odd Ref' end, case when k % 3 = 0 then {S('k')} else '' end, '\" DUEDATE=\"19950131\" AMOUNT=\"', {BAL}, '\" POLARITY=\"DEBIT\"/>')"
OPEN = f"concat('<BILLOUTSTANDING ROWORDINAL=\"', {S('k % 10 + 1')}, '\" REFERENCEKIND=\"', case when fault = 7 then 'Advance\"' else concat('Agst Ref\" REFERENCENAME=\"R', {S('k')}, '\"') end, ' PENDINGAMOUNT=\"-', {BAL}, '\" OVERDUEDAYS=\"', {S('k % 90')}, '\"/>')"


def _rows(v, **texts):
    """``(file, fault, n texts by name, ...)``: of each file of ten customers the records' texts, in their order."""
    k = F.col("c_custkey")
    rows = v.table("customer").select(k.alias("k"), F.call_function("div", k, F.lit(10)).alias("file"), "c_acctbal").withColumn("fault", F.col("file") % 10)
    made = [F.array_sort(F.collect_list(F.when(F.expr(when), F.struct("k", F.expr(text).alias("t"))))).alias(name) for name, (when, text) in texts.items()]
    return rows.groupBy("file", "fault").agg(*made)


def _joined(name):
    return F.array_join(F.transform(name, lambda x: x["t"]), "")


def _captured(per, context, counts, body):
    """``(file, xml)``: an envelope around a context with counts and records; faults 1 to 5 and 8 are those of any observation."""
    f, two = F.col("fault"), F.when(F.col("fault") == 5, 1).otherwise(0)
    claims = F.concat(*[F.concat(F.lit(f' {claim}="'), (F.size(name) + (F.when(f == 1, 1).otherwise(0) + two if name == counts[0][1] else 0)).cast("string"), F.lit('"')) for claim, name in counts])
    again = F.when(f == 5, F.coalesce(F.get(counts[0][1], 0)["t"], F.lit(""))).otherwise("")
    first = F.concat(F.lit(f"<{context[0]}"), F.when(f == 2, context[1].replace("raw-1", "raw-9")).otherwise(context[1]), claims, F.lit("/>"))
    xml = F.concat(F.lit("<ENVELOPE><HEADER><STATUS>"), F.when(f == 3, "0").otherwise("1"), F.lit("</STATUS></HEADER><BODY>"), first, body, again, F.when(f == 4, "<OTHER/>").otherwise(""), F.lit("</BODY></ENVELOPE>"))
    return per.select("file", F.when(f == 8, F.substring(xml, 1, 120)).otherwise(xml).alias("xml"))


ANY = "when 1 then 'count_mismatch' when 2 then 'profile_mismatch' when 3 then 'application_rejected' when 4 then 'wrong_grammar' when 5 then 'duplicate_observation' when 6 then 'invalid_value' when 8 then 'malformed_xml'"
FILES = "(select c_custkey as k, c_custkey // 10 as file, c_custkey // 10 % 10 as fault, c_acctbal from customer)"


@query(f"""select file, case when k % 4 = 0 then 'registration' else 'tax' end as kind, case when k % 4 = 0 then 'L' || k else 'V' || k end as guid, case when k % 4 > 0 then k % 4 end as ordinal, case when k % 4 = 0 then {GSTIN} end as gstin, case when k % 4 > 0 then {BAL} end as value,
sha256(case when k % 4 = 0 then {REGISTRATION} else {LINE} end) as sha256, null as reason from {FILES} where fault in (0, 9)
union all select distinct file, null, null, null, null, null, null, case fault {ANY} when 7 then 'missing_identity' end from {FILES} where fault not in (0, 9)""")
def tax_observations(v):
    """Registrations and voucher tax lines; captures whose claims, grammar or records contradict each other are refused whole."""
    per = _rows(v, taxes=("k % 4 > 0", LINE), registrations=("k % 4 = 0", REGISTRATION))
    context = ("INDIATAXCONTEXT", ' SCHEMA="tax-raw-1" PROFILE="tax" OBJECTTYPE="INDIATAXOBSERVATION" COMPANYGUID="CO-1" FROMDATE="19920101" TODATE="19981231"')
    rows = _elements(_captured(per, context, (("VOUCHERTAXCOUNT", "taxes"), ("TAXREGISTRATIONCOUNT", "registrations")), F.concat(_joined("registrations"), _joined("taxes"))), "file", "xml")
    return observations.tax(rows, "file", "tax-raw-1", "tax")[1].select("file", "kind", "guid", "ordinal", "gstin", "value", "sha256", "reason")


@query(f"""select file, 'allocation' as kind, case when k % 4 = 1 then 'ledgeropening' else 'voucher' end as origin, case when k % 4 <> 1 then 'V' || k end as voucher, k % 10 + 1 as ordinal, case k % 3 when 0 then 'new_reference' when 1 then 'on_account' else 'unclassified' end as reference_kind, case when k % 3 = 0 then 'R' || k end as reference,
{BAL} as amount, null as overdue_days, sha256({ALLOCATION}) as sha256, null as reason from {FILES} where fault in (0, 9) and k % 2 = 1
union all select file, 'outstanding', null, null, k % 10 + 1, 'against_reference', 'R' || k, '-' || {BAL}, k % 90, sha256({OPEN}), null from {FILES} where fault in (0, 9) and k % 2 = 0
union all select distinct file, null, null, null, null, null, null, null, null, null, case fault {ANY} when 7 then 'invalid_value' end from {FILES} where fault not in (0, 9)""")
def payment_observations(v):
    """Allocations and outstanding rows of one party, with kinds of reference, unknown ones included."""
    per = _rows(v, allocations=("k % 2 = 1", ALLOCATION), outstanding=("k % 2 = 0", OPEN))
    context = ("BILLSPARTYCONTEXT", ' SCHEMA="bills-raw-1" PROFILE="bills" OBJECTTYPE="PARTYOUTSTANDING" COMPANYGUID="CO-1" PARTYLEDGER="Party" FROMDATE="19920101" TODATE="19981231" ASOFDATE="19981231" DIRECTION="RECEIVABLE" QUERYPROFILE="q" BILLWISESTATE="ENABLED"')
    rows = _elements(_captured(per, context, (("ALLOCATIONCOUNT", "allocations"), ("OUTSTANDINGCOUNT", "outstanding")), F.concat(_joined("allocations"), _joined("outstanding"))), "file", "xml")
    return observations.payments(rows, "file", "bills-raw-1", "bills")[1].select("file", "kind", "origin", "voucher", "ordinal", "reference_kind", "reference", "amount", "overdue_days", "sha256", "reason")


SET = "sha256(string_agg(length('L' || k) || ':L' || k, '' order by 'L' || k))"


@query(f"""with f as (select file, fault, count(*) as n, {SET} as ids from {FILES} group by file, fault)
select file, case when fault in (4, 5, 6, 7, 8) then null else case fault when 1 then n - 1 else n end end as created, case when fault in (4, 5, 6, 7, 8) then null when fault = 2 then 2 else 0 end as line_errors,
case when fault = 3 then sha256(ids || 'x') when fault not in (9) then ids end as claimed, case fault when 4 then 'wrong_root' when 5 then 'repeated_field' when 6 then 'counter_invalid' when 7 then 'no_counters' when 8 then 'wrong_grammar' end as reason,
case when fault in (3, 4, 5, 6, 7, 8, 9) then 'unknown' when fault in (1, 2) then 'partial' when file // 10 % 2 = 1 then 'contradicted' else 'applied' end as outcome from f""")
def write_outcomes(v):
    """Import answers in three shapes, with their read-backs: applied, partial, contradicted or unknown."""
    k = F.col("c_custkey")
    per = v.table("customer").select(k.alias("k"), F.call_function("div", k, F.lit(10)).alias("file")).groupBy("file").agg(F.sort_array(F.collect_list(F.concat(F.lit("L"), F.col("k").cast("string")))).alias("ids"))
    f, n = F.col("file") % 10, F.size("ids")
    claimed = observations.set_sha256(F.col("ids"))
    number = lambda c: F.when(f == 6, "many").otherwise(c.cast("string"))
    fields = F.concat(F.lit("<CREATED>"), number(F.when(f == 1, n - 1).otherwise(n)), F.lit("</CREATED><ALTERED>0</ALTERED><LASTVCHID>7</LASTVCHID>"), F.when(f == 2, "<LINEERROR>a</LINEERROR><LINEERROR>b</LINEERROR>").otherwise(""), F.when(f == 5, "<ALTERED>0</ALTERED>").otherwise(""), F.when(f == 8, "<NEW>1</NEW>").otherwise(""))
    fields = F.when(f == 7, "<ERRORS>1</ERRORS>").otherwise(fields)
    wrapped = F.when(F.col("file") % 3 == 1, F.concat(F.lit("<IMPORTRESULT>"), fields, F.lit("</IMPORTRESULT>"))).otherwise(fields)
    envelope = F.concat(F.lit("<ENVELOPE><HEADER><STATUS>1</STATUS></HEADER><BODY><DATA>"), wrapped, F.lit("</DATA></BODY></ENVELOPE>"))
    answer = F.when(f == 4, "<OTHER/>").when(F.col("file") % 3 == 0, F.concat(F.lit("<RESPONSE>"), fields, F.lit("</RESPONSE>"))).otherwise(envelope)
    echoed = F.when(f == 3, F.sha2(F.concat(claimed, F.lit("x")), 256)).otherwise(claimed)
    present = F.when(F.call_function("div", F.col("file"), F.lit(10)) % 2 == 1, F.slice("ids", 1, n - 1)).otherwise(F.col("ids"))
    ledgers = F.array_join(F.transform(present, lambda x: F.concat(F.lit('<LEDGER GUID="'), x, F.lit('"><PARENT>p</PARENT></LEDGER>'))), "")
    back = F.concat(F.lit("<ENVELOPE><HEADER><STATUS>"), F.when(f == 9, "0").otherwise("1"), F.lit('</STATUS></HEADER><BODY><COMPANYCONTEXT QUERYIDENTITYSETSHA256="'), echoed, F.lit('"/>'), ledgers, F.lit("</BODY></ENVELOPE>"))
    imported = observations.imports(_elements(per.select("file", answer.alias("xml")), "file", "xml"), "file")
    read = observations.read_backs(_elements(per.select("file", back.alias("xml")), "file", "xml"), "file")
    asked = per.select("file", n.cast("long").alias("created"), F.lit(0).alias("altered"), F.lit(0).alias("deleted"), claimed.alias("set_sha256"))
    found = observations.outcomes(asked, imported, read, "file")
    return found.join(imported.select("file", "created", "line_errors", "reason"), "file").join(read.select("file", "claimed"), "file")
