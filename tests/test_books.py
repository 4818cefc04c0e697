"""Collection readers on captures that fail: a row with a reason each, whatever else is in the table."""

from pyspark.sql import functions as F

from foliant.sources import books


def envelope(rows, status="<STATUS>1</STATUS>"):
    return f"<ENVELOPE><HEADER>{status}</HEADER><BODY><DATA><COLLECTION>{rows}</COLLECTION></DATA></BODY></ENVELOPE>"


BAD = {"missing": None, "malformed_xml": "<ENVELOPE><BODY>", "source_reported_failure": envelope("", "<STATUS>0</STATUS>"), "collection_missing": "<ENVELOPE><HEADER><STATUS>1</STATUS></HEADER><BODY/></ENVELOPE>", "empty_collection": envelope("")}


def captures(spark, *good):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(good)] + list(BAD.items()), "k string, xml string")


def reasons(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["k"], []).append(r["reason"])
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_groups(spark):
    good, foreign = envelope('<GROUP NAME="a"><GUID>c-1</GUID></GROUP><GROUP NAME=" "><GUID>x-2</GUID></GROUP>'), envelope('<GROUP NAME="a"><GUID>x-1</GUID></GROUP>')
    found = reasons(books.groups(captures(spark, good, foreign), F.lit("C"), kept=("k",)))
    assert found == {"0": [None, "group_name_missing_or_duplicate"], "1": ["company_mismatch"], **{k: [k] for k in BAD}}


def test_currency_extents_and_balances(spark):
    one = '<CURRENCY NAME="x"><MAILINGNAME> indian rupees </MAILINGNAME></CURRENCY>'
    found = {r["k"]: (r["masters"], r["inr"], r["reason"]) for r in books.currency(captures(spark, envelope(one), envelope(one * 2)), "k").collect()}
    assert found == {"0": (1, True, None), "1": (2, False, None), **{k: (0, False, k) for k in BAD}}
    company = "<COMPANY><GUID>C</GUID><BOOKSFROM>{}</BOOKSFROM><LASTVOUCHERDATE>20200101</LASTVOUCHERDATE><ALTVCHID>1</ALTVCHID><ALTMSTID>2</ALTMSTID></COMPANY>"
    good = company.format("20190401")
    found = reasons(books.extents(captures(spark, envelope(good), envelope(good * 2), envelope(company.format("20191301")), envelope(good.replace("<GUID>C", "<GUID>D"))), "k", F.lit("c")))
    assert found == {"0": [None], "1": ["company_extent_not_unique"], "2": ["extent_invalid"], "3": ["company_mismatch"], **{k: [k] for k in BAD}, "empty_collection": ["company_extent_not_unique"]}
    ledger = '<LEDGER NAME="a"><OPENINGBALANCE>{}</OPENINGBALANCE><CLOSINGBALANCE/></LEDGER>'
    found = reasons(books.balances(captures(spark, envelope(ledger.format("1.5")), envelope(ledger.format("x")), envelope(ledger.format("") * 2)), "k"))
    assert found == {"0": [None], "1": ["bad_amount"], "2": ["duplicate_identity"] * 2, **{k: [k] for k in BAD}}


def test_witnesses_and_vouchers_of_an_empty_window(spark):
    row = "<VOUCHER><GUID>{}</GUID><ALTERID>1</ALTERID><DATE>{}</DATE></VOUCHER>"
    found = reasons(books.witnesses(captures(spark, envelope(row.format("c-1", "20200101")), envelope(row.format("", "20200101")), envelope(row.format("c-1", "2020"))), kept=("k",)))
    assert found == {"0": [None], "1": ["missing_guid"], "2": ["date_invalid"], **{k: [k] for k in BAD if k != "empty_collection"}}
    day = lambda d: F.lit(d).cast("date")
    vouchers = books.vouchers(captures(spark, envelope(row.format("c-1", "20200101"))), F.lit("c"), day("2020-01-01"), day("2020-01-31"), F.lit(0), F.lit(9))
    assert {r["reason"] for r in vouchers.collect()} == {None, *BAD} - {"empty_collection"}


def test_openings_companies_and_catalogue(spark):
    ledger = "<LEDGER NAME='{0}'><GUID>{1}</GUID><COMPANYGUID>{2}</COMPANYGUID><ISBILLWISEON>{3}</ISBILLWISEON><OPENINGBALANCE>2</OPENINGBALANCE></LEDGER>"
    own = ledger.format("a", "1", "C", "Yes")
    rows = captures(spark, envelope(own + ledger.format("b", "2", "c", "No")), envelope(own + ledger.format("B", "2", "d", "")), envelope(own + ledger.format("A", "2", "c", "No")), envelope(own + ledger.format("", "2", "c", "No")))
    found = {r["k"]: (r["ledgers"], r["bill_wise_opening"], r["reason"]) for r in books.opening_coverages(rows, "k").collect()}
    assert found == {"0": (2, 1, None), "1": (None, None, "bad_ledger"), "2": (2, 1, None), "3": (2, 1, None), **{k: (None, None, k) for k in BAD}}
    found = reasons(books.catalogue(rows, "k", F.lit("C")))
    assert found == {"0": [None], "1": ["context_mismatch"], "2": ["duplicate_identity"], "3": ["ledger_incomplete"], **{k: [k] for k in BAD}}
    assert reasons(books.catalogue(rows, "k", F.lit("C"), most=1))["0"] == ["too_many_ledgers"]
    company = "<COMPANY NAME='{}'><GUID>{}</GUID></COMPANY>"
    several = captures(spark, envelope(company.format("a", "1") + company.format("b", "2")), envelope(company.format("a", "x") + company.format("b", "X")), envelope(company.format("", "1")), envelope(company.format("a", "1") * 3))
    found = reasons(books.companies(several, "k", most=2))
    assert found == {"0": [None, None], "1": ["duplicate_company"] * 2, "2": ["company_incomplete"], "3": ["too_many_companies"], **{k: [k] for k in BAD}}
