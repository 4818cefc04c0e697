"""Queries on outstandings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import bucket, due_state, overdue_days
from ..functions.exact import MONEY, total
from ..operators import order
from ..operators import outstandings as op
from .registry import query

AS_OF = "date '1998-12-31'"
AGE = f"case when due_date <= {AS_OF} then date_diff('day', due_date, {AS_OF}) end"
M = "decimal(18,2)"


def _m(expression: str) -> str:
    return f"cast(coalesce({expression}, 0) as {M})"


def _report(age: str, first: str) -> str:
    tier = [f"({age} <= 30{first})", f"({age} > 30 and {age} <= 60)", f"({age} > 60 and {age} <= 90)", f"({age} > 90)"]
    names = [n for _, n in op.BUCKETS]
    sums = ", ".join(f"{_m(f'sum(-closing) filter (where closing < 0 and {t})')} as {n}" for t, n in zip(tier, names, strict=True))
    counts = ", ".join(f"count(*) filter (where closing < 0 and {t}) as n{n[1:]}" for t, n in zip(tier, names, strict=True))
    return f"select {_m('sum(-closing) filter (where closing < 0)')} as receivable, {_m('sum(closing) filter (where closing > 0)')} as payable, {sums}, {counts}, count(*) filter (where closing < 0) as open_bills, count(*) filter (where closing < 0 and {age} is null) as not_due"


@query(f"{_report('age', ' or age is null')} from (select *, {AGE} as age from v_bill where closing <> 0)")
def outstandings_report(v):
    """Totals, ageing amounts and counts by due date; bills not yet due are in the first bucket."""
    return op.bill_totals(v.bill, overdue_days(F.col("due_date"), v.as_of), not_due_first=True)


@query(f"select kind, tier, {_m('sum(abs(closing))')} as amount, count(*) as bills from (select *, {AGE} as age, case when {AGE} is null or {AGE} <= 30 then '0-30' when {AGE} <= 60 then '31-60' when {AGE} <= 90 then '61-90' else '90+' end as tier from v_bill) where kind = 'receivable' group by kind, tier")
def ageing_buckets_native(v):
    tier = F.coalesce(bucket(overdue_days(F.col("due_date"), v.as_of)), F.lit("0-30"))
    return v.bill.filter("kind = 'receivable'").groupBy("kind", tier.alias("tier")).agg(total(F.abs("closing")).alias("amount"), F.count("*").cast("long").alias("bills"))


LIFECYCLE = """with posted as (select * from v_alloc where not cancelled and not optional and reference is not null and amount <> 0 {more}),
running as (select *, cast(sum(amount) over w as decimal(18,2)) as balance, row_number() over w as n from posted window w as (partition by party, reference order by vdate, seq, amount rows between unbounded preceding and current row)),
steps as (select *, cast(balance - amount as decimal(18,2)) as prev from running),
marks as (select *, prev * balance < 0 as flip, case when prev = 0 and balance <> 0 then bill_date when prev * balance < 0 then vdate end as start from steps),
bills as (select party, reference, arg_max(balance, n) as balance, arg_max(start, case when start is not null then n end) as start_date, count(*) filter (where flip) as flips, count(*) as allocations from marks group by party, reference)
"""


@query(LIFECYCLE.format(more="") + "select * from bills")
def bill_lifecycle(v):
    """Balance, start of exposure and sign flips of each named bill."""
    return op.lifecycle(v.alloc)


@query(LIFECYCLE.format(more=f"and vdate <= {AS_OF}") + _report(f"date_diff('day', start_date, {AS_OF})", "") + " from (select *, balance as closing from bills where balance <> 0)")
def ageing_buckets_scan(v):
    """The same figures from vouchers up to the day: bills age from the start of their exposure."""
    bills = op.lifecycle(v.alloc.filter(F.col("vdate") <= v.as_of)).withColumn("closing", F.col("balance"))
    return op.bill_totals(bills, F.date_diff(v.as_of, F.col("start_date")), not_due_first=False)


@query(f"select party, {_m('sum(amount)')} as balance, count(*) as allocations from v_alloc where not cancelled and not optional and reference is null and amount <> 0 group by party")
def on_account_balances(v):
    return op.on_account(v.alloc)


PARTY = f"select party, {_m('sum(-closing) filter (where closing < 0)')} as receivable, {_m('sum(closing) filter (where closing > 0)')} as payable, {_m('sum(abs(closing))')} as total, cast(max({AGE}) as bigint) as max_age from v_bill where closing <> 0 group by party"


@query(PARTY)
def party_rollup(v):
    return op.parties(v.bill, v.as_of)


@query(f"select * from ({PARTY}) order by total desc, party limit 10")
def top_parties(v):
    return op.top(op.parties(v.bill, v.as_of))


ANCESTRY = """up as (select lower(trim(name)) as name, lower(trim(name)) as ancestor, 0 as depth, reserved_name, case when lower(trim(parent)) <> 'primary' then lower(trim(parent)) end as next from v_group
union all select u.name, lower(trim(g.name)), u.depth + 1, g.reserved_name, case when lower(trim(g.parent)) <> 'primary' then lower(trim(g.parent)) end from up u join v_group g on u.next = lower(trim(g.name)))"""
CLASSED = f"""{ANCESTRY}, classed as (select l.name, l.parent, l.closing, bill_wise, key, coalesce(hit, false) as in_party_group, bill_wise or coalesce(hit, false) as is_party from v_ledger l
left join (select distinct name, true as hit from up where reserved_name in ('Sundry Debtors', 'Sundry Creditors')) p on p.name = lower(trim(l.parent)))"""
RESIDUAL = f"""{CLASSED}, residual as (select name as party, cast(closing - coalesce(billed, 0) as {M}) as residual from classed left join (select party, sum(closing) as billed from v_bill group by party) b on b.party = name where is_party)"""


@query(f"with {ANCESTRY} select name, ancestor, cast(depth as bigint) as depth, reserved_name from up", recursive=True)
def group_ancestry(v):
    return op.ancestry(v.group)


@query(f"with {CLASSED} select name, parent, bill_wise, in_party_group, is_party from classed", recursive=True)
def party_classification(v):
    return op.party_ledgers(v.ledger, v.group).select("name", "parent", "bill_wise", "in_party_group", "is_party")


@query(f"with {RESIDUAL} select party, residual from residual", recursive=True)
def party_residuals(v):
    return op.residuals(v.ledger, v.group, v.bill).select("party", "residual")


@query(f"with {RESIDUAL} select {_m('sum(abs(residual))')} as residual_total, coalesce(bool_or(residual < 0), false) as has_unaged, count(*) as parties, count(*) filter (where residual = 0) as zero_parties from residual", recursive=True)
def residual_total(v):
    return op.residuals(v.ledger, v.group, v.bill).agg(total(F.abs("residual")).alias("residual_total"), F.coalesce(F.bool_or(F.col("residual") < 0), F.lit(False)).alias("has_unaged"), F.count("*").cast("long").alias("parties"), F.count_if(F.col("residual") == 0).cast("long").alias("zero_parties"))


LOOSE = f"{RESIDUAL}, loose as (select party, cast(abs(residual) as {M}) as amount, case when residual < 0 then 'receivable' else 'payable' end as direction from residual where residual <> 0)"


@query(f"with {LOOSE} select * from loose order by amount desc, party limit 10", recursive=True)
def unallocated_ranked(v):
    return op.unallocated(op.residuals(v.ledger, v.group, v.bill)).orderBy(F.desc("amount"), F.asc("party")).limit(10)


@query(f"select count(*) as bills, count(*) filter (where source_overdue is distinct from {AGE}) as mismatched, count(*) filter (where closing >= 0) as sign_errors from v_bill where kind = 'receivable'")
def overdue_crosscheck(v):
    """Source overdue days against the due date, and the sign guard; any mismatch makes a report partial."""
    age = overdue_days(F.col("due_date"), v.as_of)
    return v.recv.agg(F.count("*").cast("long").alias("bills"), F.count_if(~F.col("source_overdue").eqNullSafe(age)).cast("long").alias("mismatched"), F.count_if(F.col("closing") >= 0).cast("long").alias("sign_errors"))


OPEN = f"select party, case when trim(reference) = '' then '(no reference)' else reference end as reference, bill_date, due_date, cast(abs(closing) as {M}) as amount, cast({AGE} as bigint) as age, kind from v_bill where closing <> 0"


@query(f"select party, reference, cast(bill_date as varchar) as bill_date, cast(due_date as varchar) as due_date, amount, age, kind, row_number() over (order by age desc nulls last, party, reference, kind) as place from ({OPEN})")
def open_bills_ordered(v):
    """All open bills as listed, with their places: oldest first, those not due last."""
    rows = order.placed(op.open_bill_rows(v.bill, v.as_of), F.desc_nulls_last("age"), F.asc("party"), F.asc("reference"), F.asc("kind"))
    return rows.select("party", "reference", F.col("bill_date").cast("string").alias("bill_date"), F.col("due_date").cast("string").alias("due_date"), "amount", "age", "kind", "place")


@query(f"select party, reference, amount, age, kind, place, all_bills > 2000 as capped from (select *, row_number() over (partition by party order by age desc nulls last, due_date, reference, kind) as place, count(*) over (partition by party) as all_bills from ({OPEN})) where place <= 2000")
def open_bills_capped(v):
    """The bills of each party as displayed, at most ``DISPLAYED``, and whether there are more."""
    return op.displayed(op.open_bill_rows(v.bill, v.as_of), op.DISPLAYED).select("party", "reference", "amount", "age", "kind", "place", "capped")


@query(f"select party, reference, cast(bill_date as varchar) as bill_date, cast(due_date as varchar) as due_date, amount, age, kind, coalesce(case when age <= 30 then '0-30' when age <= 60 then '31-60' when age <= 90 then '61-90' when age > 90 then '90+' end, 'not due') as tier from ({OPEN}) where party = (select min(party) from v_bill)")
def party_statement(v):
    """One party's bills; those not due are a tier of their own."""
    first = v.bill.agg(F.min("party").alias("_party"))
    rows = op.open_bill_rows(v.bill, v.as_of).join(F.broadcast(first), F.col("party") == F.col("_party"))
    return rows.select("party", "reference", F.col("bill_date").cast("string").alias("bill_date"), F.col("due_date").cast("string").alias("due_date"), "amount", "age", "kind", F.coalesce(bucket(F.col("age")), F.lit("not due")).alias("tier"))


@query(f"select party, kind, {_m('sum(amount) filter (where age is null)')} as not_due, {_m('sum(amount) filter (where age <= 30)')} as b0_30, {_m('sum(amount) filter (where age > 30 and age <= 60)')} as b31_60, {_m('sum(amount) filter (where age > 60 and age <= 90)')} as b61_90, {_m('sum(amount) filter (where age > 90)')} as b90_plus, {_m('sum(amount)')} as total, count(*) as bills from ({OPEN}) group by party, kind")
def statement_subtotals(v):
    return op.statement(op.open_bill_rows(v.bill, v.as_of))


@query(f"""with {LOOSE}, b as (select party, sum(amount) filter (where kind = 'receivable') as br, sum(amount) filter (where kind = 'payable') as bp, count(*) as bills from ({OPEN}) group by party),
u as (select party, sum(amount) filter (where direction = 'receivable') as ur, sum(amount) filter (where direction = 'payable') as up from loose group by party)
select coalesce(b.party, u.party) as party, coalesce(bills, 0) as bills, cast(coalesce(br, 0) + coalesce(ur, 0) as {M}) as receivable, cast(coalesce(bp, 0) + coalesce(u.up, 0) as {M}) as payable from b full join u on b.party = u.party""", recursive=True)
def statement_manifest(v):
    return op.manifest(op.open_bill_rows(v.bill, v.as_of), op.unallocated(op.residuals(v.ledger, v.group, v.bill)))


@query(f"with {LOOSE} select distinct party from (select party from v_bill where closing <> 0 union all select party from loose)", recursive=True)
def statement_parties(v):
    return v.bill.filter("closing <> 0").select("party").unionByName(op.unallocated(op.residuals(v.ledger, v.group, v.bill)).select("party")).distinct()


@query(f"""with {LOOSE}, t as (select (select sum(-closing) from v_recv) as r, (select sum(closing) from v_pay) as p, (select sum(amount) from loose) as u)
select part, cast(coalesce(amount, 0) as {M}) as amount, cast(round(100 * cast(coalesce(amount, 0) as double) / cast(r + p + u as double)) as bigint) as percent from (select 'receivable' as part, r as amount, r, p, u from t union all select 'payable', p, r, p, u from t union all select 'unallocated', u, r, p, u from t)""", recursive=True)
def exposure_composition(v):
    """Shares of receivable, payable and unallocated money."""
    bills = v.bill.select(F.col("kind").alias("part"), F.abs("closing").alias("amount"))
    loose = op.unallocated(op.residuals(v.ledger, v.group, v.bill)).select(F.lit("unallocated").alias("part"), "amount")
    parts = bills.unionByName(loose).groupBy("part").agg(total(F.col("amount")).alias("amount"))
    share = 100 * F.col("amount").cast("double") / F.sum("amount").over(Window.partitionBy(F.lit(1))).cast("double")  # over three rows
    return parts.withColumn("percent", F.round(share).cast("long"))


CLIENT = f"""with bills as (select *, {AGE} as age from v_bill), c as (select parent as client, {_m('sum(-b.closing) filter (where b.closing < 0)')} as receivable, {_m('sum(-b.closing) filter (where b.closing < 0 and age > 90)')} as overdue, cast(max(age) as bigint) as oldest, count(distinct party) as parties from bills b join v_ledger on party = name group by parent)"""


def _clients(v):
    age = overdue_days(F.col("due_date"), v.as_of)
    owner = v.ledger.select("name", F.col("parent").alias("client"))
    owed = F.col("closing") < 0
    per_party = v.bill.groupBy("party").agg(F.sum(F.when(owed, -F.col("closing"))).alias("r"), F.sum(F.when(owed & (age > 90), -F.col("closing"))).alias("o"), F.max(age).alias("a"))
    return per_party.join(owner, F.col("party") == F.col("name")).groupBy("client").agg(total(F.col("r")).alias("receivable"), total(F.col("o")).alias("overdue"), F.max("a").cast("long").alias("oldest"), F.count("*").cast("long").alias("parties"))


@query(f"{CLIENT} select * from c")
def client_rollup(v):
    """Per client (the ledger's group): receivable, what is over 90 days, the oldest age and its parties."""
    return _clients(v)


@query(f"{CLIENT} select *, row_number() over (order by coalesce(oldest, -1) desc, client) as place from c")
def client_sorted(v):
    return order.placed(_clients(v), F.desc(F.coalesce("oldest", F.lit(-1))), F.asc("client"))


@query(f"""{CLIENT}, labels as (select n_name as client, trim(r_name) as label from nation join region on n_regionkey = r_regionkey where r_name <> 'AFRICA')
select coalesce(label, c.client) as label, label is not null as grouped, count(*) as clients, case when count(*) filter (where oldest is null) = 0 then cast(sum(receivable) as {M}) end as receivable from c left join labels l on l.client = c.client group by coalesce(label, c.client), label is not null""")
def client_groups(v):
    """Clients under their label, others by themselves; a member without an age makes the total unavailable."""
    labels = v.group.filter("parent not in ('Primary', 'AFRICA')").select(F.col("name").alias("_c"), F.trim("parent").alias("label"))
    rows = _clients(v).join(op.checked(labels), F.col("client") == F.col("_c"), "left")
    whole = F.when(F.count_if(F.col("oldest").isNull()) == 0, F.sum("receivable").cast(MONEY))
    return rows.groupBy(F.coalesce("label", "client").alias("label"), F.col("label").isNotNull().alias("grouped")).agg(F.count("*").cast("long").alias("clients"), whole.alias("receivable"))


@query(f"select party, reference, case when due_date < {AS_OF} then 'overdue' when due_date = {AS_OF} then 'due_today' else 'not_due' end as state, cast(abs(date_diff('day', due_date, {AS_OF})) as bigint) as days from v_bill")
def due_states(v):
    return v.bill.select("party", "reference", due_state(F.col("due_date"), v.as_of).alias("state"), F.abs(F.date_diff(v.as_of, "due_date")).cast("long").alias("days"))


@query(f"""with companies as (select n_name as company, n_nationkey % 5 as k from nation), b as (select parent as company, b.closing, {AGE} as age from v_bill b join v_ledger on party = name)
select c.company, case when k = 4 then 'partial' else 'complete' end as status, case when k = 4 then 'currency_not_supported' end as reason_code, case when k <> 4 then {_m('sum(-closing) filter (where closing < 0)')} end as receivable, case when k <> 4 then {_m('sum(closing) filter (where closing > 0)')} end as payable from companies c left join b on b.company = c.company group by c.company, k""")
def company_sweep(v):
    """All companies in one job; a company that can't be read is a partial row and stops no other."""
    companies = v.table("nation").select(F.col("n_name").alias("company"), (F.col("n_nationkey") % 5 == 4).alias("failed"))
    owner = v.ledger.select("name", F.col("parent").alias("_c"))
    sums = v.bill.groupBy("party").agg(F.sum(F.when(F.col("closing") < 0, -F.col("closing"))).alias("r"), F.sum(F.when(F.col("closing") > 0, F.col("closing"))).alias("p")).join(owner, F.col("party") == F.col("name")).groupBy("_c").agg(total(F.col("r")).alias("r"), total(F.col("p")).alias("p"))
    rows = companies.join(sums, F.col("company") == F.col("_c"), "left")
    zero = F.lit(0).cast(MONEY)
    return rows.select("company", F.when(F.col("failed"), "partial").otherwise("complete").alias("status"), F.when(F.col("failed"), "currency_not_supported").alias("reason_code"), F.when(~F.col("failed"), F.coalesce("r", zero)).alias("receivable"), F.when(~F.col("failed"), F.coalesce("p", zero)).alias("payable"))
