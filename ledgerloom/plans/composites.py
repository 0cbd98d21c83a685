"""End-to-end datasets composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, names, texts
from ledgerloom.functions.similarity import name_score
from ledgerloom.operators import checks, linkage, panel, ranking, temporal
from ledgerloom.operators.lineage import settled

EVENT_TYPES = ("warning_letter", "recall", "adverse_event")
TOLERANCE_DAYS = 547  # 18 months
LETTER_DATA_START = "2008-10-01"


def clean_actions(raw: DataFrame) -> DataFrame:
    """Compliance actions without tobacco rows (an unknown product type stays), with dates, clean names and flags."""
    kind = F.coalesce(F.col("Product Type"), F.lit("nan"))
    is_kind = lambda v: kind == v
    return raw.filter(kind != "Tobacco").withColumns(
        {
            "action_taken_date": dates.parse_date(F.col("Action Taken Date")),
            "company_name_clean": names.collapse(F.coalesce(F.col("Legal Name"), F.lit("nan"))),
            "is_warning_letter": F.coalesce(F.col("Action Type") == "Warning Letter", F.lit(False)),
            "is_device": is_kind("Devices"),
            "is_drug": is_kind("Drugs"),
            "is_biologic": is_kind("Biologics"),
            "is_medtech_pharma": kind.isin("Devices", "Drugs", "Biologics"),
        }
    )


def attach_market_value(events: DataFrame, fundamentals: DataFrame, day: str = "action_taken_date") -> DataFrame:
    """Market value at the latest fiscal year end before the event, at most 18 months old."""
    known = fundamentals.withColumn("mktcap", F.col("prcc_f") * F.col("csho")).filter("mktcap IS NOT NULL")
    known = known.select("gvkey", "datadate", "mktcap", F.col("datadate").alias("fundamentals_date"))
    out = temporal.asof_backward(events, known, ["gvkey"], day, "datadate", ["mktcap", "fundamentals_date"], TOLERANCE_DAYS)
    return out.withColumn("has_mktcap", F.col("mktcap").isNotNull())


def attach_classification(recalls: DataFrame, enforcement: DataFrame) -> DataFrame:
    """Recall class by product number, else by event number; recalls without a report stay, unclassified."""
    fields = ["classification", "voluntary_mandated", "recall_initiation_date", "center_classification_date", "initial_firm_notification"]
    e = enforcement.withColumns({"__num": F.trim("recall_number"), "__ev": F.trim("event_id")})
    product = ranking.keep_first(e.filter("__num IS NOT NULL"), ["__num"], ["__ev", *fields]).select("__num", *fields)
    event = ranking.keep_first(e.filter("__ev IS NOT NULL"), ["__ev"], ["__num", *fields]).select(
        "__ev", F.col("classification").alias("__c"), F.col("voluntary_mandated").alias("__v")
    )
    rows = recalls.withColumns({"__num": F.trim("product_res_number"), "__ev": F.trim("res_event_number")})
    joined = rows.join(product, "__num", "left").join(event, "__ev", "left")
    filled = joined.withColumns({"classification": F.coalesce("classification", "__c"), "voluntary_mandated": F.coalesce("voluntary_mandated", "__v")})
    return filled.drop("__num", "__ev", "__c", "__v")


def link_recalls(recalls: DataFrame, by_id: DataFrame, by_name: DataFrame) -> DataFrame:
    """Recalls linked by establishment, else by name; the year is that of initiation, else of posting."""
    day = F.coalesce(dates.parse_date(F.col("event_date_initiated")), dates.parse_date(F.col("event_date_posted")))
    rows = recalls.withColumns({"event_date": day, "year": F.year(day), "fei": names.normalize_fei(F.col("firm_fei_number")), "name_key": names.normalize_name(F.col("recalling_firm"))})
    return temporal.two_route_link(rows, by_id, by_name, "fei", "name_key", "year")


def unlinked_worklist(linked: DataFrame) -> DataFrame:
    """Unlinked firms with how many recalls they have and when."""
    rest = linked.filter("link_key IS NULL AND name_key IS NOT NULL AND name_key <> ''")
    return rest.groupBy("name_key").agg(
        F.count(F.lit(1)).alias("n_recalls"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date")
    )


def flatten_adverse_events(reports: DataFrame, keep_text: bool = False) -> DataFrame:
    """One flat row per report: the first device's fields, counts, problems joined without nulls."""
    first = F.get("device", F.lit(0))
    own = ["manufacturer_d_name", "brand_name", "generic_name", "model_number", "device_report_product_code", "implant_flag", "device_operator"]
    scalars = [c for c, t in reports.dtypes if not t.startswith(("array", "struct"))]
    columns = [
        *[F.col(c) for c in scalars],
        F.coalesce(F.size("device"), F.lit(0)).alias("n_devices_listed"),
        *[first[c].alias(c) for c in own],
        first["openfda"]["device_class"].alias("device_class"),
        first["openfda"]["medical_specialty_description"].alias("medical_specialty"),
        F.coalesce(F.size("patient"), F.lit(0)).alias("n_patients_listed"),
        names.joined(F.col("product_problems")).alias("product_problems"),
    ]
    if keep_text:
        said = F.filter(F.transform("mdr_text", lambda t: t["text"]), lambda t: t.isNotNull() & (t != ""))
        columns.append(F.coalesce(F.array_join(said, " || "), F.lit("")).alias("mdr_text"))
    return reports.select(*columns)


def link_adverse_events(reports: DataFrame, exact: DataFrame, index: DataFrame, windows: DataFrame, report_id: str) -> DataFrame:
    """Reports kept if any listed device's maker links, exactly or by prefix, within its ownership window.

    Makers are resolved once each; a report of unknown year passes the window.
    """
    makers = reports.select(report_id, F.posexplode(F.transform("device", lambda d: d["manufacturer_d_name"])).alias("pos", "maker"))
    # The key is made of an aggregate, so that its patterns are not pushed to the rows before they are distinct.
    distinct = makers.groupBy("maker").agg(F.max("maker").alias("__name")).withColumn("name_key", names.normalize_name(F.col("__name"))).drop("__name").filter("name_key <> ''")
    known = linkage.resolve_tiers(distinct, exact, index, "name_key", "gvkey", row_id="maker").filter("gvkey IS NOT NULL")
    hit = makers.join(known.select("maker", "name_key", "gvkey", "link_tier"), "maker")
    best = hit.groupBy(report_id).agg(F.min_by(F.struct("name_key", "gvkey", "link_tier"), "pos").alias("b")).select(report_id, "b.*")
    day = F.coalesce(dates.parse_date(F.col("date_received"), ("yyyyMMdd",)), dates.parse_date(F.col("date_of_event"), ("yyyyMMdd",)))
    joined = reports.join(best, report_id).withColumns({"event_date": day, "year": F.year(day)})
    bounded = temporal.with_default_window(joined, windows, ["name_key", "gvkey"])
    return bounded.filter(temporal.in_window_or_unknown(F.col("year"), F.col("valid_from"), F.col("valid_to")))


def product_codes(raw: DataFrame) -> DataFrame:
    """One clean row per product code, all other columns prefixed 'dev_'; blanks are NULL, Y and N booleans."""
    strings = [c for c, t in raw.dtypes if t == "string"]
    clean = raw.withColumns({c: F.when(~F.col(c).rlike(r"^\s*$"), F.col(c)) for c in strings})
    clean = clean.withColumns({"product_code": F.upper(F.trim("product_code")), "device_class_num": F.col("device_class").try_cast("int")})
    flags = ["implant_flag", "life_sustain_support_flag", "gmp_exempt_flag", "third_party_flag"]
    clean = clean.withColumns({f"{f}_bool": F.when(F.col(f) == "Y", True).when(F.col(f) == "N", False) for f in flags if f in raw.columns})
    one = ranking.keep_first(clean, ["product_code"], sorted(c for c in clean.columns if c != "product_code"))
    return one.select("product_code", *[F.col(c).alias(f"dev_{c}") for c in one.columns if c != "product_code"])


def firm_year_panel(letters: DataFrame, recalls: DataFrame, adverse: DataFrame, active: DataFrame, master: DataFrame) -> DataFrame:
    """Events by firm, year and type over active firm-years, with firm metadata.

    Letters count case ids, recalls event ids with their classes, adverse events reports with their tiers.
    """
    cls = lambda v: F.col("classification") == v
    parts = [
        panel.event_panel(letters, ["gvkey", "year"], "case_id", {}).withColumn("event_type", F.lit("warning_letter")),
        panel.event_panel(
            recalls.filter("cfres_id IS NOT NULL"), ["gvkey", "year"], "cfres_id",
            {"n_recall_class_i": cls("Class I"), "n_recall_class_ii": cls("Class II"), "n_recall_class_iii": cls("Class III")},
        ).withColumn("event_type", F.lit("recall")),
        panel.event_panel(
            adverse, ["gvkey", "year"], None, {"n_mdr_tier_a": F.col("link_tier") == "A_exact", "n_mdr_tier_b": F.col("link_tier") == "B_prefix"}
        ).withColumn("event_type", F.lit("adverse_event")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    gated = panel.active_gate(out, active, ["gvkey", "year"])
    meta = ranking.keep_first(master.select("gvkey", "conm", "sic", "costat", "cik"), ["gvkey"], ["conm", "sic", "costat", "cik"])
    counts = [c for c in out.columns if c.startswith("n_")]
    joined = gated.join(meta, "gvkey", "left").withColumnRenamed("conm", "company_name_compustat")
    return joined.select("gvkey", "year", "event_type", *counts, "company_name_compustat", "sic", "costat", "cik")


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are worked out once a row: a later filter on them takes their values and not their expressions."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def classify_filings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lead, event flags and product domain of event filings."""
    body = F.col(text)
    led = _once(docs, {"lead": texts.lead(body), "lead_source": texts.lead_source(body), "doc_chars": F.length(body)})
    says = texts.event_hits(body, F.col("lead"))
    flagged = _once(led, says).withColumns(texts.flags_of({n: F.col(n) for n in says})).drop(*[n for n in says if "_says_" in n])
    hits = texts.domain_hits(body)
    leads = {f"domain_{n}_lead_hits": c for n, c in texts.domain_hits(F.col("lead")).items()}
    counted = _once(flagged, {**{f"domain_{n}_hits": c for n, c in hits.items()}, **leads})
    labelled = counted.withColumn("product_domain", texts.domain_label({n: F.col(f"domain_{n}_hits") for n in hits}))
    return labelled.withColumn("is_device_domain", F.col("product_domain") == "device")


def sic_bucket(sic: Column) -> Column:
    number = sic.try_cast("int")
    return F.when(number.between(3841, 3845), "device").when(number.between(2833, 2836), "pharma_bio").otherwise("other")


def device_set(filings: DataFrame) -> DataFrame:
    """Filings about a panel event that are about devices by their text, or by industry where the text is silent."""
    silent = F.col("product_domain").isin("unspecified", "mixed") & (F.col("sic_bucket") == "device")
    evidence = F.when(F.col("product_domain") == "device", "text").when(silent, "sic_fallback")
    rows = filings.filter("n_flags > 0").withColumn("sic_bucket", sic_bucket(F.col("sic")))
    return rows.withColumn("device_evidence", evidence).filter("device_evidence IS NOT NULL")


def score_filings(filings: DataFrame, text: str = "text") -> DataFrame:
    """Mentions, substantive and hedged ones by event in both sections of a filing, and totals over them."""
    sections = {"rf": "risk_factors", "mda": "mda"}
    cut = filings.withColumn("__sections", texts.sections(F.col(text), F.col("form"), tuple(sections.values())))
    rows = cut.withColumns({f"__{s}": F.col("__sections")[name] for s, name in sections.items()})
    scored = rows.withColumns({f"__{s}_{e}": texts.mention_scores(F.col(f"__{s}"), texts.FILING_TERMS[e]) for s in sections for e in EVENT_TYPES})
    out = {f"has_{name}": F.length(f"__{s}") > 0 for s, name in sections.items()} | {f"{s}_chars": F.length(f"__{s}") for s in sections}
    for e in EVENT_TYPES:
        for what in ("mentions", "substantive", "hedged"):
            out |= {f"{s}_{e}_{what}": F.col(f"__{s}_{e}.{what}") for s in sections}
        for what in ("mentions", "substantive"):
            out[f"{e}_{what}_total"] = F.col(f"__rf_{e}.{what}") + F.col(f"__mda_{e}.{what}")
    return scored.withColumns(out).drop(text, "__sections", *[f"__{s}" for s in sections], *[f"__{s}_{e}" for s in sections for e in EVENT_TYPES])


KEY = ["gvkey", "reporting_year", "reporting_quarter"]


def _sweep(book: checks.Reconciliation, filings: DataFrame, branches: list[tuple[str, DataFrame, str, dict[str, str]]]) -> tuple[DataFrame, list[str]]:
    """Sums by filing of the branches' rows in its period and, as fy_n_..., in its fiscal year; and the names of the sums of periods.

    ``branches``: (branch, rows by firm and day, day, {column: name of its sum}),
    the first column being how many events a row stands for.  All branches go
    through one sweep over the firms' days, a row with a number for its branch
    and the columns in slots, and become columns where they are summed up.
    """
    tall = None
    for i, (_, rows, day, names) in enumerate(branches):
        part = rows.select("gvkey", F.col(day).alias("day"), F.lit(i).alias("branch"), *[F.col(c).alias(f"m{j}") for j, c in enumerate(names)])
        tall = part if tall is None else tall.unionByName(part, allowMissingColumns=True)
    period = filings.select(*KEY, F.col("period_start").alias("start"), F.col("period_end").alias("end"))
    year = filings.filter("fy_start IS NOT NULL").select(*KEY, F.col("fy_start").alias("start"), F.col("period_end").alias("end"))
    found = temporal.assign_in_one_sweep(tall, ["gvkey"], "day", {"quarter": period, "year": year})
    slots = {name: (i, f"m{j}") for i, (_, _, _, names) in enumerate(branches) for j, name in enumerate(names.values())}
    for i, (branch, _, _, _) in enumerate(branches):
        found = _placed(book, found, branch, F.when(F.col("branch") == i, F.col("m0")))
    kinds = F.array(*[F.struct(f"{kind}.*", F.lit(kind == "year").alias("yearly")) for kind in ("quarter", "year")])
    each = found.select("gvkey", "branch", *sorted({m for _, m in slots.values()}), F.inline(kinds)).filter("reporting_year IS NOT NULL")
    of = lambda i, m, yearly: F.when((F.col("branch") == i) & (F.col("yearly") == yearly), F.col(m))
    wide = {name: of(i, m, False) for name, (i, m) in slots.items()}
    wide |= {f"fy_{name}": of(i, m, True) for name, (i, m) in slots.items() if m == "m0" and branches[i][0] != "reports"}
    # Still by firm, so that this is no shuffle; aggregated once, since each aggregation holds its groups in memory.
    return panel.counts_by_key(each.select(*KEY, *[c.alias(n) for n, c in wide.items()]), KEY, {n: n for n in wide}), list(slots)


def _placed(book: checks.Reconciliation, rows: DataFrame, branch: str, n: Column) -> DataFrame:
    """Events with their periods, under observation: how many came, found a period, lie outside of all, have no date."""
    known = F.col("day").isNotNull()
    found = F.col("gvkey").isNotNull() & F.coalesce(F.col("quarter.reporting_year").isNotNull() & F.col("quarter.reporting_quarter").isNotNull(), F.lit(False))
    part = lambda which: F.sum(F.when(which, n))
    book.law(f"{branch} came and found", lambda t: t[branch + "_in"]["n"], lambda t: sum(t[branch].values()))
    return book.watch(rows, branch, assigned=part(found), outside=part(~found & known), undated=part(~found & ~known))


def combine(
    filings: DataFrame,
    events: dict[str, DataFrame],
    reports: DataFrame,
    active: DataFrame,
    book: checks.Reconciliation | None = None,
    letters_since: str = LETTER_DATA_START,
) -> DataFrame:
    """Filings with the events of their reporting periods and, for annual ones, of their fiscal years.

    ``filings``: scored filings with periods (unique by firm, year and quarter).
    ``events``: by type, (gvkey, event_date, n, ...) at firm-day grain.
    ``reports``: flags of current reports by (gvkey, file_date).
    ``book`` receives the totals of every branch and their laws: each event is
    assigned, outside of all periods or without a date, each one assigned is
    counted at one filing, and no filing is lost or doubled.

    Filings are written once, with their fiscal years and whether the firm was
    active: texts are not scored again, and what is joined by other keys is
    joined while filings are narrow.  Events of all types and reports find
    both their period and their fiscal year in one sweep, and the sums meet the
    filings in one join.
    """
    book = book or checks.Reconciliation()
    annual, covered = F.col("form") == "10-K", F.lit(letters_since).cast("date")
    gate = active.select("gvkey", F.col("year").alias("reporting_year"))
    flagged = panel.active_flag(temporal.with_fiscal_starts(filings, annual), gate, ["gvkey", "reporting_year"], "compustat_active_year")
    filings = checks.unique(settled(flagged.withColumn("compustat_active_year", F.col("compustat_active_year").cast("int"))), KEY)
    extra = {"recall": {"class_i": "n_recall_class_i", "class_ii": "n_recall_class_ii", "class_iii": "n_recall_class_iii"}, "adverse_event": {"tier_a": "n_mdr_tier_a", "tier_b": "n_mdr_tier_b"}}
    branches = []
    for e, rows in events.items():
        renamed = {"n": f"n_{e}"} | {k: v for k, v in extra.get(e, {}).items() if k in rows.columns}
        branches.append((e, book.watch(rows, f"{e}_in", n=F.sum("n")), "event_date", renamed))
    flags = {"__one": "n_8k_any_event"} | {f"flag_{e}": f"n_8k_{e}" for e in events}
    came = book.watch(reports, "reports_in", n=F.count(F.lit(1))).withColumn("__one", F.lit(1))
    branches.append(("reports", came.groupBy("gvkey", "file_date").agg(*[F.sum(c).alias(c) for c in flags]), "file_date", flags))
    sums, counted = _sweep(book, filings, branches)
    out = book.watch(filings, "filings_in", n=F.count(F.lit(1))).join(sums, KEY, "left")
    out = out.na.fill(0, counted)  # a filing without events has true zeros
    new = {f"event_{e}": (F.col(f"n_{e}") > 0).cast("int") for e in events} | {f"has_8k_{e}": (F.col(f"n_8k_{e}") > 0).cast("int") for e in events}
    new |= {f"fy_n_{e}": F.when(annual, F.coalesce(f"fy_n_{e}", F.lit(0))) for e in events}
    new |= {"has_8k_any_event": (F.col("n_8k_any_event") > 0).cast("int"), "warning_letter_data_covered": (F.col("period_start") >= covered).cast("int")}
    new |= {"fy_warning_letter_data_covered": F.when(annual, (F.col("fy_start") >= covered).cast("int"))}
    new |= {f"mda_{e}_substantive_flag": (F.col(f"mda_{e}_substantive") > 0).cast("int") for e in events if f"mda_{e}_substantive" in filings.columns}
    out = out.withColumns(new).withColumns({f"fy_event_{e}": (F.col(f"fy_n_{e}") > 0).cast("int") for e in events})
    out = out.withColumns({"event_any": panel.any_flag(*[f"event_{e}" for e in events]), "event_letter_or_recall": panel.any_flag("event_warning_letter", "event_recall")})
    counts = {e: f"n_{e}" for e in events} | {"reports": "n_8k_any_event"}
    book.law("filings in and out", lambda t: t["filings_in"]["n"], lambda t: t["filings"]["n"])
    for branch in counts:
        book.law(f"{branch} assigned and counted", lambda t, b=branch: t[b]["assigned"], lambda t, b=branch: t["filings"][b])
    return book.watch(out, "filings", n=F.count(F.lit(1)), **{branch: F.sum(c) for branch, c in counts.items()})


def combined_shares(combined: DataFrame) -> DataFrame:
    """By reporting year and event: filings, those of periods with an event, and how many of either kind disclose it substantively.

    Filings whose period the letters' data do not cover are left out for letters.
    """
    kinds = F.array(
        *[
            F.struct(
                F.lit(e).alias("event"),
                F.col(f"event_{e}").alias("happened"),
                F.col(f"mda_{e}_substantive_flag").alias("told"),
                (F.col("warning_letter_data_covered") == 1 if e == "warning_letter" else F.lit(True)).alias("covered"),
            )
            for e in EVENT_TYPES
        ]
    )
    rows = combined.select("reporting_year", F.explode(kinds).alias("k")).filter("k.covered").select("reporting_year", "k.event", "k.happened", "k.told")
    share = lambda n, of: F.when(F.col(of) > 0, F.round(100 * F.col(n) / F.col(of), 1))
    happened, told = F.col("happened") == 1, F.col("told") == 1
    counted = rows.groupBy("reporting_year", "event").agg(
        F.count(F.lit(1)).alias("n_filings"),
        F.count_if(happened).alias("n_with_event"),
        F.count_if(happened & told).alias("n_told_with_event"),
        F.count_if(~happened & told).alias("n_told_without_event"),
    )
    without = counted.withColumn("__without", F.col("n_filings") - F.col("n_with_event"))
    rates = {"pct_told_with_event": share("n_told_with_event", "n_with_event"), "pct_told_without_event": share("n_told_without_event", "__without")}
    return without.withColumns(rates).drop("__without")


def best_names(pairs: DataFrame, row_id: str, listing: str, own: str, former: str) -> DataFrame:
    """Best score of a listing name against an entity's own and former names, its own on ties: name_score, matched_name.

    ``row_id`` is unique.
    """
    each = pairs.select(row_id, listing, own, F.explode(F.array_union(F.array(own), F.coalesce(F.col(former), F.array().cast("array<string>")))).alias("__name"))
    scored = each.withColumn("__s", name_score(F.col(listing), F.col("__name")))
    order = F.struct(F.col("__s"), (F.col("__name") == F.col(own)).alias("own"))
    best = scored.groupBy(row_id).agg(F.max(order).alias("__best"), F.collect_list(F.struct(order.alias("o"), F.col("__name").alias("n"))).alias("__all"))
    name = F.array_min(F.transform(F.filter("__all", lambda x: x["o"] == F.col("__best")), lambda x: x["n"]))
    return pairs.join(best.select(row_id, F.col("__best")["__s"].alias("name_score"), name.alias("matched_name")), row_id)


def accept_candidates(pages: DataFrame) -> DataFrame:
    """Candidate pages judged: (text, case_id, action_date, names, index_vouches) -> doc_type, gaps and accept."""
    text = F.coalesce("text", F.lit(""))
    kind = texts.letter_type(text)
    doc_type = F.when(F.col("text").isNull(), "fetch failed").when((kind == "unknown") & F.col("index_vouches"), "warning letter").otherwise(kind)
    plain = F.concat(F.lit(" "), F.regexp_replace(F.upper(text), "[^A-Z0-9 ]", " "), F.lit(" "))
    firsts = F.filter(F.transform("names", lambda n: F.split_part(F.trim(n), F.lit(" "), F.lit(1))), lambda w: w.isNotNull() & (w != ""))
    named = F.exists(firsts, lambda w: F.contains(plain, F.concat(F.lit(" "), w, F.lit(" "))))
    gap = dates.nearest_gap(dates.text_dates(F.substring(text, 1, 3000)), F.col("action_date"))
    judged = pages.withColumns(
        {"doc_type": doc_type, "date_gap_days": gap, "case_id_in_text": texts.printed_id(text, F.col("case_id")), "name_in_text": named, "text_chars": F.length(text)}
    )
    near = F.col("name_in_text") & F.coalesce(F.col("date_gap_days") <= 31, F.lit(False))
    accept = (F.col("doc_type") == "warning letter") & (F.col("text_chars") > 1500) & (F.col("case_id_in_text") | near)
    return judged.withColumn("accept", accept)
