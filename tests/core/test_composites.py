from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import names, texts
from ledgerloom.operators import checks
from ledgerloom.plans import composites as c

d = date.fromisoformat


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_clean_actions(spark):
    rows = [("A  Co", "Devices", "1/5/2020", "Warning Letter"), ("T", "Tobacco", "2020-01-05", "Warning Letter"), (None, None, "bad", "Seizure")]
    df = spark.createDataFrame(rows, "`Legal Name` string, `Product Type` string, `Action Taken Date` string, `Action Type` string")
    got = sorted(c.clean_actions(df).select("company_name_clean", "action_taken_date", "is_device", "is_warning_letter", "is_medtech_pharma").collect())
    assert [tuple(r) for r in got] == [("A Co", d("2020-01-05"), True, True, True), ("nan", None, False, False, False)]


def test_market_value(spark):
    ev = spark.createDataFrame([("1", d("2020-06-30")), ("1", d("2021-12-29")), ("1", d("2021-12-30")), ("2", d("2020-01-01"))], "gvkey string, action_taken_date date")
    f = spark.createDataFrame([("1", d("2020-06-30"), 2.0, 3.0), ("1", d("2019-06-30"), 1.0, 3.0)], "gvkey string, datadate date, prcc_f double, csho double")
    got = {(r.gvkey, r.action_taken_date): r.mktcap for r in c.attach_market_value(ev, f).collect()}
    assert got == {("1", d("2020-06-30")): 3.0, ("1", d("2021-12-29")): 6.0, ("1", d("2021-12-30")): None, ("2", d("2020-01-01")): None}


def test_recall_classes(spark):
    r = spark.createDataFrame([("Z-1 ", "10"), ("Z-9", "10"), ("Z-8", "99")], "product_res_number string, res_event_number string")
    e = spark.createDataFrame([("Z-1", "10", "Class I", "V", "a", "b", "c"), ("Z-2", "10", "Class II", "V", "a", "b", "c")], "recall_number string, event_id string, classification string, voluntary_mandated string, recall_initiation_date string, center_classification_date string, initial_firm_notification string")
    got = {x.product_res_number: x.classification for x in c.attach_classification(r, e).collect()}
    assert got == {"Z-1 ": "Class I", "Z-9": "Class I", "Z-8": None}


def test_adverse_events(spark):
    schema = (
        "report string, date_received string, date_of_event string, device array<struct<manufacturer_d_name:string,brand_name:string,generic_name:string,model_number:string,"
        "device_report_product_code:string,implant_flag:string,device_operator:string,openfda:struct<device_class:string,medical_specialty_description:string>>>, "
        "patient array<struct<n:string>>, product_problems array<string>, mdr_text array<struct<text:string>>"
    )
    dev = lambda m: (m, "b", None, None, "ABC", None, None, ("2", None))
    rows = [
        ("r1", "20200105", None, [dev("Nobody"), dev("ACME INC")], [("1",)], ["x", None, "y"], [("t1",), (None,), ("t2",)]),
        ("r2", None, None, [dev("ACME SURGICAL EAST LLC")], None, [None], None),
        ("r3", "19900101", None, [dev("ACME INC")], [], None, []),
        ("r4", "20200105", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    flat = {r.report: r for r in c.flatten_adverse_events(df, keep_text=True).collect()}
    assert (flat["r1"].product_problems, flat["r1"].n_devices_listed, flat["r1"].device_class, flat["r1"].mdr_text) == ("x; y", 2, "2", "t1 || t2")
    assert (flat["r2"].product_problems, flat["r2"].n_patients_listed, flat["r4"].n_devices_listed) == (None, 0, 0)
    exact = spark.createDataFrame([("ACME", "1")], "name_key string, gvkey string")
    index = spark.createDataFrame([("ACME SURGICAL", "2"), ("ACME", "1")], "name_key string, gvkey string")
    windows = spark.createDataFrame([("ACME", "1", 2000, 2030)], "name_key string, gvkey string, valid_from int, valid_to int")
    got = {r.report: (r.gvkey, r.link_tier) for r in c.link_adverse_events(df, exact, index, windows, "report").collect()}
    assert got == {"r1": ("1", "A_exact"), "r2": ("2", "B_prefix")}


def test_product_codes(spark):
    df = spark.createDataFrame([(" abc ", "2", "Y", " "), ("ABC", "2", "Y", "x"), ("def", "x", "?", "y")], "product_code string, device_class string, implant_flag string, other string")
    got = {r.product_code: (r.dev_device_class_num, r.dev_implant_flag_bool) for r in c.product_codes(df).collect()}
    assert got == {"ABC": (2, True), "DEF": (None, None)}


def test_panel(spark):
    letters = spark.createDataFrame([("1", 2020, "a"), ("1", 2020, "a"), ("2", 2020, "b"), (None, 2020, "c")], "gvkey string, year int, case_id string")
    recalls = spark.createDataFrame([("1", 2020, "x", "Class I"), ("1", 2020, None, "Class I")], "gvkey string, year int, cfres_id string, classification string")
    adverse = spark.createDataFrame([("1", 2020, "A_exact"), ("1", 2020, "B_prefix")], "gvkey string, year int, link_tier string")
    active = spark.createDataFrame([("1", 2020)], "gvkey string, year int")
    master = spark.createDataFrame([("1", "ACME", "3841", "A", "9")], "gvkey string, conm string, sic string, costat string, cik string")
    got = {r.event_type: r for r in c.firm_year_panel(letters, recalls, adverse, active, master).collect()}
    assert got["warning_letter"].n_events == 1 and got["recall"].n_recall_class_i == 1 and got["adverse_event"].n_mdr_tier_b == 1 and len(got) == 3


def test_filings(spark):
    rows = [("Item 8.01 The FDA sent a warning letter on our catheter stent and medical device.", "2834"), ("Item 8.01 FDA warning letter.", "3841"), ("Item 8.01 FDA warning letter.", "2834"), ("nothing", "3841")]
    got = c.device_set(c.classify_filings(spark.createDataFrame(rows, "text string, sic string"))).select("sic", "device_evidence").collect()
    assert sorted(tuple(r) for r in got) == [("2834", "text"), ("3841", "sic_fallback")]


def test_scores(spark):
    body = "Item 1A. " + "we received a warning letter in 2020 and any recall may occur. " * 10 + "Item 1B. Item 7. short Item 8."
    row = c.score_filings(spark.createDataFrame([(body, "10-K")], "text string, form string")).first()
    assert row.has_risk_factors and not row.has_mda and row.rf_warning_letter_mentions == 10 and row.rf_recall_hedged == 10
    assert row.warning_letter_substantive_total == row.rf_warning_letter_substantive > 0 and row.rf_recall_substantive == 0


def test_combined(spark):
    schema = "gvkey string, accession string, form string, filing_date date, reporting_year int, reporting_quarter int, period_start date, period_end date, mda_recall_substantive int"
    filings = spark.createDataFrame(
        [("1", "q1", "10-Q", d("2020-05-01"), 2020, 1, d("2019-12-31"), d("2020-03-31"), 1), ("1", "k", "10-K", d("2021-02-01"), 2020, 4, d("2020-09-30"), d("2020-12-31"), 0)], schema
    )
    ev = lambda rows: spark.createDataFrame(rows, "gvkey string, event_date date, n int, class_i int")
    events = {"warning_letter": ev([("1", d("2020-03-31"), 2, 0), ("1", d("2019-12-31"), 5, 0)]), "recall": ev([("1", d("2020-10-01"), 3, 1), ("1", d("2020-06-01"), 4, 0)])}
    reports = spark.createDataFrame([("1", d("2020-01-15"), 1, 0)], "gvkey string, file_date date, flag_warning_letter int, flag_recall int")
    active = spark.createDataFrame([("1", 2020)], "gvkey string, year int")
    got = {r.accession: r for r in c.combine(filings, events, reports, active).collect()}
    q, k = got["q1"], got["k"]
    assert (q.n_warning_letter, q.n_recall, q.n_8k_warning_letter, q.n_8k_any_event, q.event_any, q.mda_recall_substantive_flag) == (2, 0, 1, 1, 1, 1)
    assert (k.n_recall, k.n_recall_class_i, k.fy_n_recall, k.fy_n_warning_letter, k.event_letter_or_recall) == (3, 1, 7, 2, 1)
    assert q.fy_n_recall is None and k.warning_letter_data_covered == 1 and k.compustat_active_year == 1


def test_candidates(spark):
    long = "WARNING LETTER\nJanuary 5, 2020\nACME Devices\n" + "text " * 400
    rows = [(long, "12345", d("2020-01-10"), ["ACME"], False), (long + " 12345", "12345", d("2015-01-10"), ["ZETA"], False), (long, "12345", d("2015-01-10"), ["ACME"], False), ("12345 " * 400, "12345", d("2020-01-01"), [], True), (None, "1", d("2020-01-01"), [], True)]
    df = spark.createDataFrame(rows, "text string, case_id string, action_date date, names array<string>, index_vouches boolean")
    assert [r.accept for r in c.accept_candidates(df).collect()] == [True, True, False, True, False]


def test_names_of_letters(spark):
    df = spark.createDataFrame([(1, "ACME DIVISION OF ZETA", "ACME", ["ZETA"]), (2, "OTHER", "ACME", None)], "id int, listing string, own string, former array<string>")
    got = {r.listing: (r.matched_name, r.name_score >= 99) for r in c.best_names(df, "id", "listing", "own", "former").collect()}
    assert got["ACME DIVISION OF ZETA"] == ("ACME", True) and got["OTHER"][1] is False
    assert one(spark, texts.recipient(F.col("t"), F.col("l")), t="WARNING LETTER\n\nAcme Corp\nx", l="") == "Acme Corp"
    assert one(spark, texts.recipient(F.col("t"), F.col("l")), t="Acme, Inc. - 3/4/05\nx", l="") == "Acme, Inc."
    assert one(spark, texts.recipient(F.col("t"), F.col("l")), t="x", l="Listed") == "Listed"
    assert one(spark, names.page_id(F.col("u")), u="http://x/2010/ucm123.htm") == "ucm123"
    case = one(spark, names.case_in_url(F.col("u")), u="http://x/acme-612345-01052020/")
    assert (case.case_id, case.dated) == ("612345", d("2020-01-05"))
    assert one(spark, names.partition_tag(F.col("u")), u="https://x/2019q3/device-event-0002-of-0005.json.zip") == "2019q3__0002-of-0005"
    place = lambda t: one(spark, names.mentions_place(F.col("t"), F.lit("Texas"), F.lit("TX"), F.array(F.lit("England"))), t=t)
    assert place("in texas.") and place("Austin, TX 78701") and place("London, England") and not place("Austin TX")


def _branches(spark):
    schema = "gvkey string, accession string, form string, filing_date date, reporting_year int, reporting_quarter int, period_start date, period_end date, mda_recall_substantive int"
    filings = spark.createDataFrame(
        [("1", "q1", "10-Q", d("2020-05-01"), 2020, 1, d("2019-12-31"), d("2020-03-31"), 1), ("1", "k", "10-K", d("2021-02-01"), 2020, 4, d("2020-09-30"), d("2020-12-31"), 0)], schema
    )
    ev = lambda rows: spark.createDataFrame(rows, "gvkey string, event_date date, n int")
    events = {"warning_letter": ev([("1", d("2020-03-31"), 2), ("1", d("2019-12-31"), 5), ("1", None, 7), (None, d("2020-03-01"), 1)]), "recall": ev([])}
    reports = spark.createDataFrame([("1", d("2020-01-15"), 1, 0)], "gvkey string, file_date date, flag_warning_letter int, flag_recall int")
    return filings, events, reports, spark.createDataFrame([("1", 2020)], "gvkey string, year int")


def test_combined_totals_are_observed(spark):
    book = checks.Reconciliation()
    c.combine(*_branches(spark), book=book).collect()
    found = book.verify()
    assert found["warning_letter"] == {"assigned": 2, "outside": 6, "undated": 7} and found["recall_in"] == {"n": 0}
    assert found["filings"] == {"n": 2, "warning_letter": 2, "recall": 0, "reports": 1} and found["reports"]["assigned"] == 1


def test_a_lost_row_raises(spark, monkeypatch):
    whole = c.panel.counts_by_key
    lossy = lambda rows, keys, names: whole(rows, keys, names).filter("reporting_quarter <> 1") if "reporting_quarter" in keys else whole(rows, keys, names)
    monkeypatch.setattr(c.panel, "counts_by_key", lossy)
    book = checks.Reconciliation()
    c.combine(*_branches(spark), book=book).collect()
    with pytest.raises(checks.CheckFailed, match="assigned and counted: 2 and 0"):
        book.verify()


def test_a_doubled_filing_raises(spark):
    filings, *rest = _branches(spark)
    with pytest.raises(checks.CheckFailed, match="not unique"):
        c.combine(filings.unionAll(filings), *rest)


def test_counts_taken_twice_are_counted_anew(spark):
    class Twice:
        get = {"n": 8}

    book = checks.Reconciliation()
    rows = spark.range(4)
    book.watch(rows, "rows", n=F.count(F.lit(1))).collect()
    book.law("rows", lambda t: t["rows"]["n"], lambda t: 4)
    assert book.verify() == {"rows": {"n": 4}}
    book._watched["rows"] = (*book._watched["rows"][:2], Twice())  # as after a stage that ran again
    assert book.verify() == {"rows": {"n": 4}}
    with pytest.raises(ValueError):
        book.watch(rows, "rows", n=F.count(F.lit(1)))
