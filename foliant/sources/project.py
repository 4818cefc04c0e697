"""Accounting views over the star-schema tables.

Each view exists twice: as a DataFrame built here, and as DuckDB SQL in
``SQL``, from which the oracles are put together. Debit amounts are negative.
"""

from __future__ import annotations

import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import MONEY

AS_OF = datetime.date(1998, 12, 31)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of = F.lit(AS_OF)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def group(self) -> DataFrame:
        """name, parent, reserved_name: nations below their region, regions below the root."""
        nations, regions = self.table("nation"), self.table("region")
        low = nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"), F.lit("").alias("reserved_name"))
        reserved = F.when(F.col("r_name") == "ASIA", "Sundry Debtors").when(F.col("r_name") == "EUROPE", "Sundry Creditors").otherwise("")
        return low.unionByName(regions.select(F.col("r_name").alias("name"), F.lit("Primary").alias("parent"), reserved.alias("reserved_name")))

    @cached_property
    def recv(self) -> DataFrame:
        """Open receivable bills: orders with status O."""
        bill, key = F.to_date("o_orderdate"), F.col("o_orderkey")
        due = F.date_add(bill, (30 * (key % 4)).cast("int"))
        rows = self.table("orders").filter("o_orderstatus = 'O'").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        overdue = F.when(due <= self.as_of, F.date_diff(self.as_of, due) + F.when(key % 97 == 0, 1).otherwise(0))
        return rows.select(F.col("c_name").alias("party"), F.concat(F.lit("O"), key.cast("string")).alias("reference"), bill.alias("bill_date"), due.alias("due_date"), (-F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("closing"), overdue.cast("int").alias("source_overdue"))

    @cached_property
    def pay(self) -> DataFrame:
        """Open payable bills: a supplier's open lines of every fifth order."""
        rows = self.table("lineitem").filter("l_linestatus = 'O' and l_orderkey % 5 = 0")
        rows = rows.groupBy("l_suppkey", "l_orderkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("closing"), F.min(F.to_date("l_shipdate")).alias("bill_date"))
        rows = rows.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return rows.select(F.col("s_name").alias("party"), F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("reference"), "bill_date", F.date_add("bill_date", 30).alias("due_date"), "closing", F.lit(None).cast("int").alias("source_overdue"))

    @cached_property
    def bill(self) -> DataFrame:
        """All open bills with their kind."""
        return self.recv.withColumn("kind", F.lit("receivable")).unionByName(self.pay.withColumn("kind", F.lit("payable")))

    @cached_property
    def ledger(self) -> DataFrame:
        """name, parent, closing, bill_wise; every seventeenth ledger closes at the sum of its bills."""
        c = self.table("customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast(MONEY).alias("own"), F.col("c_custkey").alias("key"))
        s = self.table("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").cast(MONEY).alias("own"), F.col("s_suppkey").alias("key"))
        nations = F.broadcast(self.table("nation").select("n_nationkey", F.col("n_name").alias("parent")))
        billed = self.bill.groupBy("party").agg(F.sum("closing").cast(MONEY).alias("billed"))
        rows = c.unionByName(s).join(nations, F.col("nation") == F.col("n_nationkey")).join(billed, F.col("name") == F.col("party"), "left")
        closing = F.when(F.col("key") % 17 == 0, F.coalesce("billed", F.lit(0).cast(MONEY))).otherwise(F.col("own"))
        return rows.select("name", "parent", closing.cast(MONEY).alias("closing"), (F.col("key") % 3 != 0).alias("bill_wise"), "key")

    @cached_property
    def voucher(self) -> DataFrame:
        key = F.col("o_orderkey")
        rows = self.table("orders").join(self.table("customer").select("c_custkey", F.col("c_name").alias("party")), F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(key.alias("vid"), F.to_date("o_orderdate").alias("vdate"), F.col("o_orderpriority").alias("vtype"), ((F.col("o_orderstatus") == "F") & (key % 7 == 0)).alias("cancelled"), (key % 11 == 0).alias("optional"), "party", F.col("o_totalprice").cast(MONEY).alias("total"))

    @cached_property
    def entry(self) -> DataFrame:
        """Two legs a line: the customer's debit and, but for some lines, the supplier's credit."""
        price = F.col("l_extendedprice").cast(MONEY)
        lines = self.table("lineitem")
        left = lines.join(self.voucher.select("vid", "party"), F.col("l_orderkey") == F.col("vid")).select("vid", F.col("party").alias("ledger"), F.lit("customer").alias("side"), (-price).cast(MONEY).alias("amount"), F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 2), "credit").otherwise("debit").alias("polarity"))
        kept = lines.filter("not (l_returnflag = 'R' and l_linenumber = 1)")
        right = kept.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("vid"), F.col("s_name").alias("ledger"), F.lit("supplier").alias("side"), price.alias("amount"), F.lit("credit").alias("polarity"))
        return left.unionByName(right)

    @cached_property
    def leg(self) -> DataFrame:
        """The entries' vouchers and amounts alone, without the ledgers' names and the joins these take."""
        lines, price = self.table("lineitem"), F.col("l_extendedprice").cast(MONEY)
        debit = lines.select(F.col("l_orderkey").alias("vid"), (-price).cast(MONEY).alias("amount"))
        return debit.unionByName(lines.filter("not (l_returnflag = 'R' and l_linenumber = 1)").select(F.col("l_orderkey").alias("vid"), price.alias("amount")))

    @cached_property
    def alloc(self) -> DataFrame:
        """Bill allocations with their order: a new reference, then payments against it."""
        v, price = self.voucher, F.col("l_extendedprice").cast(MONEY)
        shared = ["vid", "party", "cancelled", "optional", F.col("vdate").alias("bill_date")]
        new = v.select(*shared, F.lit("New Ref").alias("kind"), "vdate", (-F.col("total")).cast(MONEY).alias("amount"), F.lit(0).alias("seq"))
        against = v.join(self.table("lineitem"), (F.col("vid") == F.col("l_orderkey")) & (F.col("vid") % 10 != 0)).select(*shared, F.lit("Agst Ref").alias("kind"), F.to_date("l_shipdate").alias("vdate"), price.alias("amount"), F.col("l_linenumber").alias("seq"))
        settled = v.filter("vid % 10 = 0").select(*shared, F.lit("Agst Ref").alias("kind"), F.date_add("vdate", 60).alias("vdate"), F.col("total").alias("amount"), F.lit(1).alias("seq"))
        reopened = v.filter("vid % 20 = 0").select(*shared, F.lit("Agst Ref").alias("kind"), F.date_add("vdate", 90).alias("vdate"), F.lit(-100).cast(MONEY).alias("amount"), F.lit(2).alias("seq"))
        rows = new.unionByName(against).unionByName(settled).unionByName(reopened)
        account = F.col("vid") % 13 == 0
        return rows.withColumn("kind", F.when(account, "On Account").otherwise(F.col("kind"))).withColumn("reference", F.when(~account, F.concat(F.lit("B"), F.col("vid").cast("string"))))

    @cached_property
    def attempt(self) -> DataFrame:
        """Requests: an event each, with its latency and bytes."""
        k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
        return self.table("events").select("event_id", "user_id", "ts", F.col("event_type").alias("class"), F.round(F.col("value") * 100_000).cast("long").alias("latency_us"), (k * 1024).alias("bytes"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"))

    @cached_property
    def window(self) -> DataFrame:
        """Observations: an order in the window of its month, and some again in the next one."""
        day = F.to_date("o_orderdate")
        rows = self.table("orders").select(F.col("o_orderkey").alias("sid"), F.date_format(day, "yyyy-MM").alias("win"), day.alias("odate"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.date_format(day, "yyyy-MM-dd"), F.col("o_totalprice").cast(MONEY).cast("string")), 256).alias("hash"))
        again = rows.filter("sid % 50 = 0").select("sid", F.date_format(F.add_months("odate", 1), "yyyy-MM").alias("win"), "odate", F.when(F.col("sid") % 100 == 0, F.sha2(F.concat(F.lit("x"), F.col("hash")), 256)).otherwise(F.col("hash")).alias("hash"))
        return rows.unionByName(again)


SQL = {
    "v_group": """select n_name as name, r_name as parent, '' as reserved_name from nation join region on n_regionkey = r_regionkey
        union all select r_name, 'Primary', case r_name when 'ASIA' then 'Sundry Debtors' when 'EUROPE' then 'Sundry Creditors' else '' end from region""",
    "v_recv": """select c_name as party, 'O' || o_orderkey as reference, cast(o_orderdate as date) as bill_date,
        cast(cast(o_orderdate as date) + to_days(cast(30 * (o_orderkey % 4) as integer)) as date) as due_date, cast(-cast(o_totalprice as decimal(18,2)) as decimal(18,2)) as closing, o_orderkey as okey
        from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O'""",
    "v_pay": """select s_name as party, 'P' || l_orderkey as reference, bill_date, cast(bill_date + to_days(30) as date) as due_date, closing from
        (select l_suppkey, l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as closing, min(cast(l_shipdate as date)) as bill_date from lineitem where l_linestatus = 'O' and l_orderkey % 5 = 0 group by 1, 2) join supplier on l_suppkey = s_suppkey""",
    "v_bill": """select party, reference, bill_date, due_date, closing, case when due_date <= date '1998-12-31' then date_diff('day', due_date, date '1998-12-31') + case when okey % 97 = 0 then 1 else 0 end end as source_overdue, 'receivable' as kind from v_recv
        union all select party, reference, bill_date, due_date, closing, null, 'payable' from v_pay""",
    "v_ledger": """select name, n_name as parent, case when key % 17 = 0 then coalesce(billed, 0) else own end::decimal(18,2) as closing, key % 3 <> 0 as bill_wise, key from
        (select c_name as name, c_nationkey as nation, cast(c_acctbal as decimal(18,2)) as own, c_custkey as key from customer union all select s_name, s_nationkey, cast(s_acctbal as decimal(18,2)), s_suppkey from supplier)
        join nation on nation = n_nationkey left join (select party, sum(closing) as billed from v_bill group by party) on name = party""",
    "v_voucher": """select o_orderkey as vid, cast(o_orderdate as date) as vdate, o_orderpriority as vtype, o_orderstatus = 'F' and o_orderkey % 7 = 0 as cancelled, o_orderkey % 11 = 0 as optional, c_name as party, cast(o_totalprice as decimal(18,2)) as total
        from orders join customer on o_custkey = c_custkey""",
    "v_entry": """select vid, party as ledger, 'customer' as side, cast(-cast(l_extendedprice as decimal(18,2)) as decimal(18,2)) as amount, case when l_linestatus = 'F' and l_linenumber = 2 then 'credit' else 'debit' end as polarity from lineitem join v_voucher on l_orderkey = vid
        union all select l_orderkey, s_name, 'supplier', cast(l_extendedprice as decimal(18,2)), 'credit' from lineitem join supplier on l_suppkey = s_suppkey where not (l_returnflag = 'R' and l_linenumber = 1)""",
    "v_alloc": """select vid, party, cancelled, optional, bill_date, case when vid % 13 = 0 then 'On Account' else kind end as kind, vdate, amount, seq, case when vid % 13 <> 0 then 'B' || vid end as reference from (
        select vid, party, cancelled, optional, vdate as bill_date, 'New Ref' as kind, vdate, cast(-total as decimal(18,2)) as amount, 0 as seq from v_voucher
        union all select vid, party, cancelled, optional, vdate, 'Agst Ref', cast(l_shipdate as date), cast(l_extendedprice as decimal(18,2)), l_linenumber from v_voucher join lineitem on vid = l_orderkey and vid % 10 <> 0
        union all select vid, party, cancelled, optional, vdate, 'Agst Ref', cast(vdate + to_days(60) as date), total, 1 from v_voucher where vid % 10 = 0
        union all select vid, party, cancelled, optional, vdate, 'Agst Ref', cast(vdate + to_days(90) as date), cast(-100 as decimal(18,2)), 2 from v_voucher where vid % 20 = 0)""",
    "v_attempt": """select event_id, user_id, ts, event_type as class, cast(round(value * 100000) as bigint) as latency_us, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) * 1024 as bytes, case when event_type = 'error' then 'error' else 'ok' end as outcome from events""",
    "v_window_own": """select o_orderkey as sid, strftime(o_orderdate, '%Y-%m') as win, cast(o_orderdate as date) as odate, sha256(o_orderkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || cast(o_totalprice as decimal(18,2))) as hash from orders""",
    "v_window": """select sid, win, odate, hash from v_window_own union all select sid, strftime(odate + interval 1 month, '%Y-%m'), odate, case when sid % 100 = 0 then sha256('x' || hash) else hash end from v_window_own where sid % 50 = 0""",
}
NEEDS = {"v_bill": ("v_recv", "v_pay"), "v_ledger": ("v_bill",), "v_entry": ("v_voucher",), "v_alloc": ("v_voucher",), "v_window": ("v_window_own",)}


def with_views(sql: str, recursive: bool = False) -> str:
    """The query after the definitions of the views that it names."""
    named: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in named:
            named.append(name)

    for name in SQL:
        if name in sql.replace("v_window_own", ""):
            add(name)
    parts = [f"{n} as ({SQL[n]})" for n in named]
    body = sql.strip()
    if body.lower().startswith("with "):
        body = ", " + body[5:] if parts else body[5:]
        return f"with {'recursive ' if recursive else ''}{', '.join(parts)}{body}"
    return f"with {', '.join(parts)} {body}" if parts else body
