"""Rule-based status over event histories: was the issuer listed on a date?

An issuer has an array of filing events (t, form) and an array of periodic
filing dates; documented windows override the rules.  The first rule that
applies decides, as one CASE expression over higher-order functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.texts import let

# Forms by meaning, and the exchanges that count as listed today.
PERIODIC_FORMS = ("10-K", "10-K405", "10-KSB", "10-KSB40", "10-Q", "10-QSB", "20-F", "40-F", "10-KT")
LISTING_FORMS = ("8-A12B", "8-A12B/A", "10-12B", "10-12B/A", "8-B12B")
OFFERING_FORMS = ("S-1", "F-1", "424B4", "424B1")
OVER_THE_COUNTER_FORMS = ("8-A12G", "10-12G")
DELISTING_FORMS = ("25", "25-NSE")
DEREGISTRATION_FORMS = ("15-12B", "15-12G", "15-15D", "15F-12B", "15F-12G", "15F-15D")
EXCHANGES = ("NYSE", "Nasdaq", "CBOE", "NYSE MKT", "NYSE American", "NYSE Arca")


@dataclass(frozen=True)
class ListingRules:
    recent_days: int = 460
    first_days: int = 450
    slack_days: int = 30
    relist_gap: int = 180
    continued_days: int = 365
    few_registrations: int = 3
    records_begin: str = "1997-12-31"
    common_registration: str = "2006-08-01"


def _latest(events: Column, forms: tuple[str, ...], day: Column) -> Column:
    return F.array_max(F.transform(F.filter(events, lambda e: e["form"].isin(*forms) & (e["t"] <= day)), lambda e: e["t"]))


def exchange_status(events: Column, periodic: Column, day: Column, listed_today: Column, rules: ListingRules = ListingRules()) -> Column:
    """YES or OTC on a day by the forms of the exchanges.

    An issuer that is listed today was listed from its first registration on
    (or all along, if it is older than the records), but for the time between a
    delisting and a later listing a good while after it.  One that is not was
    listed from its latest registration until a delisting after which it went on
    reporting; without a registration before the day, a delisting after it, with
    no registration between, tells that an old issuer was listed.
    """
    registered = F.transform(F.filter(events, lambda e: e["form"].isin(*LISTING_FORMS)), lambda e: e["t"])
    delisted = F.transform(F.filter(events, lambda e: e["form"].isin(*DELISTING_FORMS)), lambda e: e["t"])
    early = F.exists(events, lambda e: e["form"].isin(*OVER_THE_COUNTER_FORMS) & (e["t"] < F.lit(rules.common_registration).cast("date")))
    first = F.array_min(F.transform(events, lambda e: e["t"]))
    started = F.exists(registered, lambda r: r <= day) | early | (first <= F.lit(rules.records_begin).cast("date"))
    apart = F.exists(delisted, lambda d: (d <= day) & F.exists(registered, lambda r: (r > day) & (F.datediff(r, d) >= rules.relist_gap)))
    now = started & ~((F.size(registered) <= rules.few_registrations) & apart)
    latest = F.array_max(F.filter(registered, lambda r: r <= day))
    left = F.exists(delisted, lambda d: (d > latest) & (d <= day) & F.exists(periodic, lambda p: F.datediff(p, d) > rules.continued_days))
    later = F.exists(delisted, lambda d: (d > day) & ~F.exists(registered, lambda r: (r > day) & (r < d)))
    old = early | (first <= F.lit(rules.common_registration).cast("date"))
    once = F.when(latest.isNotNull(), ~left).otherwise(later & old)
    return F.when(F.when(listed_today, now).otherwise(once), "YES").otherwise("OTC")


def listing_verdict(
    has_record: Column,
    events: Column,
    periodic: Column,
    windows: Column,
    automatic: Column,
    exchanges: Column,
    day: Column,
    rules: ListingRules = ListingRules(),
) -> Column:
    """struct(status, evidence, exchange) on a day: UNCLEAR, NO, OTC or YES, why, and where.

    ``windows``: array of (start, end, exchange), half-open; a NULL end is open.  ``exchanges``: those of today, which
    the automatic rules use where an issuer has no windows.
    """
    before = F.filter(periodic, lambda p: p <= day)
    last, first = F.array_max(before), F.array_min(periodic)
    registered = _latest(events, LISTING_FORMS + OFFERING_FORMS, day)
    new = F.coalesce(F.datediff(day, registered) <= rules.first_days, F.lit(False))
    ended = F.filter(
        events,
        lambda e: e["form"].isin(*DEREGISTRATION_FORMS) & (e["t"] <= day) & (last.isNull() | (F.datediff(last, e["t"]) <= rules.slack_days)),
    )
    gone = F.array_min(F.transform(ended, lambda e: e["t"]))
    inside = F.get(F.filter(windows, lambda w: (w["start"] <= day) & (w["end"].isNull() | (day < w["end"]))), 0)
    today = F.filter(exchanges, lambda x: x.isin(*EXCHANGES))
    by_rule = exchange_status(events, periodic, day, F.size(today) > 0, rules)
    seen = F.when(last.isNotNull(), F.concat(F.lit("last periodic report "), last.cast("string"))).otherwise("IPO registration within the prior 15 months")
    none = F.lit(None).cast("string")

    def is_(status: str, evidence: Column, exchange: Column = none) -> Column:
        return F.struct(F.lit(status).alias("status"), evidence.alias("evidence"), exchange.alias("exchange"))

    named = F.size(F.coalesce(windows, F.array().cast("array<struct<start:date,end:date,exchange:string>>"))) > 0
    somewhere = F.when(F.size(today) > 0, F.array_join(today, ", ")).otherwise("US exchange (not identified)")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(~has_record, is_("UNCLEAR", F.lit("no SEC record found")))
        .when(F.coalesce(F.size(periodic), F.lit(0)) <= 0, is_("NO", F.lit("SEC filer but never filed 10-K/10-Q/20-F (e.g., Form D only) - not public")))
        .when((F.size(before) == 0) & ~new, is_("NO", said("not yet public: first periodic report ", first.cast("string"))))
        .when(gone.isNotNull(), is_("NO", said("no longer public: deregistered (Form 15) ", gone.cast("string"))))
        .when((F.datediff(day, last) > rules.recent_days) & ~new, is_("NO", said("no longer public: last periodic report ", last.cast("string"))))
        .when(named & inside.isNotNull(), is_("YES", said("SEC-reporting at letter date (", seen, "); stock listed on ", inside["exchange"]), inside["exchange"]))
        .when(named, is_("OTC", said("SEC-reporting at letter date (", seen, "), but the stock was not exchange-listed then (OTC)")))
        .when(automatic & (by_rule == "YES"), is_("YES", said("SEC-reporting (", seen, "); exchange-listed per EDGAR registration/delisting record"), somewhere))
        .when(automatic, is_("OTC", said("SEC-reporting (", seen, "), but no evidence of an exchange listing")))
        .otherwise(is_("OTC", said("SEC-reporting at letter date (", seen, "), but the stock traded OTC, not on a US exchange")))
    )


def listing_status(
    has_record: Column, events: Column, periodic: Column, windows: Column, automatic: Column, exchanges: Column, day: Column, rules: ListingRules = ListingRules()
) -> Column:
    """The status of ``listing_verdict`` alone."""
    return listing_verdict(has_record, events, periodic, windows, automatic, exchanges, day, rules)["status"]


def status_label(status: Column, via_parent: Column) -> Column:
    return (
        F.when((status == "YES") & via_parent, "Yes - via parent").when(status == "YES", "Yes").when(status.isin("NO", "OTC"), "No").otherwise("Unclear")
    )


def universe_by_year(issuers: DataFrame, issuer: str, first: Column, last: Column, status) -> DataFrame:
    """(issuer, year) for every year in which the status is YES at some month end between first and last.

    ``status``: function of the day's Column.  Month ends are a bounded array within the row, so no cross join is needed.
    """
    from ledgerloom.functions.dates import month_ends

    days = F.filter(month_ends(first, last), lambda d: status(d) == "YES")
    years = F.array_distinct(F.transform(days, F.year))
    return issuers.select(issuer, F.explode(years).alias("year"))


def change_days(events: Column, periodic: Column, windows: Column, rules: ListingRules = ListingRules()) -> Column:
    """The days on which ``listing_status`` can change: filings, the ends of their times of grace, and bounds of windows."""
    filed = F.transform(events, lambda e: e["t"])
    registered = F.transform(F.filter(events, lambda e: e["form"].isin(*LISTING_FORMS, *OFFERING_FORMS)), lambda e: F.date_add(e["t"], rules.first_days + 1))
    stale = F.transform(periodic, lambda p: F.date_add(p, rules.recent_days + 1))
    bounds = F.flatten(F.transform(windows, lambda w: F.array(w["start"], w["end"])))
    none = F.array().cast("array<date>")
    return F.concat(*[F.coalesce(c, none) for c in (filed, registered, periodic, stale, bounds)])


def status_runs(first: Column, last: Column, changes: Column, status) -> Column:
    """array<struct(start, end, status)>: stretches [start, end) of one status from first to last, in order.

    ``status``: function of the day's Column that is constant between ``changes``; it is worked out on those days alone,
    however long the time is.  Neighbours of one status are one run.  NULL bounds give NULL.
    """
    inside = F.filter(changes, lambda d: d.isNotNull() & (d > first) & (d <= last))
    points = F.array_sort(F.array_distinct(F.concat(F.array(first), inside)))
    known = F.transform(points, lambda d: F.struct(d.alias("start"), status(d).alias("status")))

    def merged(found: Column) -> Column:
        return F.filter(found, lambda r, i: (i == 0) | ~r["status"].eqNullSafe(F.get(found, i - 1)["status"]))

    def closed(runs: Column) -> Column:
        end = lambda i: F.coalesce(F.get(runs, i + 1)["start"], F.date_add(last, 1))
        return F.transform(runs, lambda r, i: F.struct(r["start"].alias("start"), end(i).alias("end"), r["status"].alias("status")))

    return F.when(first.isNotNull() & last.isNotNull() & (first <= last), let(let(known, merged), closed))


def status_on(runs: Column, day: Column) -> Column:
    return F.get(F.filter(runs, lambda r: (r["start"] <= day) & (day < r["end"])), 0)["status"]


def listed_years(runs: Column, status: str = "YES") -> Column:
    """Years with a month end in a run of the status, in order: from the first month end of each run to its last one."""
    held = F.filter(runs, lambda r: (r["status"] == status) & (F.last_day(r["start"]) < r["end"]))
    years = F.transform(held, lambda r: F.sequence(F.year(F.last_day(r["start"])), F.year(F.date_sub(F.trunc(r["end"], "month"), 1))))
    return F.array_sort(F.array_distinct(F.flatten(years)))


def yearly_summary(letters: DataFrame, universe: DataFrame, issuer: str, year: str = "year", listed: str = "listed") -> DataFrame:
    """By year: letters, those to listed issuers, such issuers, the universe, and the share of it that received a letter.

    ``letters``: a row for each, with ``listed`` at its day.  ``universe``: (issuer, year), unique.  Years without a
    letter do not show; without a universe the share is NULL.  Hits are counted by a join on issuer and year, so no set
    of issuers is held by one task.
    """
    hit = letters.groupBy(year, issuer).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(listed)).alias("__listed"))
    member = hit.join(universe.select(year, issuer).withColumn("__member", F.lit(True)), [year, issuer], "left")
    known = F.col("__listed") > 0
    counted = member.groupBy(year).agg(
        F.sum("__n").alias("n_letters"),
        F.sum("__listed").alias("n_letters_to_listed"),
        F.count_if(known & F.col(issuer).isNotNull()).alias("n_listed_issuers"),
        F.count_if(known & F.col("__member")).alias("n_universe_issuers"),
    )
    sizes = universe.groupBy(year).agg(F.count(F.lit(1)).alias("n_universe"))
    out = counted.join(sizes, year, "left").na.fill(0, ["n_universe"])
    return out.withColumn("pct_of_universe", F.when(F.col("n_universe") > 0, F.round(100 * F.col("n_universe_issuers") / F.col("n_universe"), 1)))
