"""Pages that may belong to a letter, by name and date, and one page for each letter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import mentions_place
from ledgerloom.functions.similarity import indel_ratio, token_set_ratio, words

from .lineage import settled
from .linkage import similar_names


def page_candidates(letters: DataFrame, pages: DataFrame, days: int = 15, least: float = 80.0) -> DataFrame:
    """(case_id, page_id, score, name_ratio): pages whose company fits a name of the letter, issued within ``days`` of it.

    ``letters``: (case_id, day, names), one row a case; ``pages``: (page_id,
    issued, company), where a page may stand more than once and its best row
    counts.  The score is the best ``token_set_ratio`` of the names less the
    days apart, and is ``least`` or more; ``name_ratio`` is the best plain
    ratio of that row.  Nulls in either's columns fit nothing.

    No pair of a day meets all pages of its days: names that share a word meet
    by word and days, and names that share none reach ``least`` by the ratio
    of their sorted words alone, whose pairs ``similar_names`` finds, by days
    too.
    """
    # A letter's days lie in two buckets at most, and mostly in one.
    number = lambda c, more=0: F.floor((F.unix_date(F.col(c)) + more) / (4 * days + 1))
    as_set = lambda c: F.array_join(F.array_sort(F.array_distinct(words(F.col(c)))), " ")
    listed = pages.select("page_id", "issued", "company").dropna().distinct()
    asked = letters.filter(F.col("day").isNotNull()).select("case_id", "day", F.explode("names").alias("name")).dropna().distinct()
    l = asked.withColumns({"__b": F.explode(F.array_distinct(F.array(number("day", -days), number("day", days)))), "__u": as_set("name")})
    p = listed.withColumns({"__b": number("issued"), "__v": as_set("company")})
    by_word = l.withColumn("__w", F.explode(F.array_distinct(words(F.col("name"))))).join(p.withColumn("__w", F.explode(F.array_distinct(words(F.col("company"))))), ["__b", "__w"])
    alike = similar_names(l.select("__b", "__u"), p.select("__b", "__v"), "__u", "__v", least, ("__b",)).select("__u", "__v")
    # Names that share a word have met by it.
    alike = alike.filter(~F.coalesce(F.arrays_overlap(words(F.col("__u")), words(F.col("__v"))), F.lit(False)))
    by_letters = l.join(alike, "__u").join(p, ["__b", "__v"])
    columns = ["case_id", "day", "page_id", "issued", "company"]
    near = F.abs(F.datediff("day", "issued")) <= days
    met = by_word.filter(near).select(*columns).unionByName(by_letters.filter(near).select(*columns)).distinct()
    known = letters.select("case_id", "names")
    best = lambda f: F.array_max(F.transform(F.filter("names", lambda n: n.isNotNull()), lambda n: f(n, F.col("company"))))
    scored = met.join(known, "case_id").withColumn("score", best(token_set_ratio) - F.abs(F.datediff("day", "issued")))
    kept = scored.filter(F.col("score") >= least).withColumn("name_ratio", best(indel_ratio))
    top = F.max(F.struct("score", "name_ratio")).alias("__t")
    return kept.groupBy("case_id", "day", "page_id").agg(top).select("case_id", "day", "page_id", "__t.*")


def one_page_each(candidates: DataFrame, sure: float = 90.0) -> DataFrame:
    """One page for each letter, each page for one letter: (case_id, page_id, by_place).

    ``candidates``: (case_id, day, page_id, score, name_ratio, in_place), one
    row a pair.  Letters choose in the order of their days (then cases).  The
    only page that is still free is taken for its name alone if the names are
    ``sure`` alike; else the best of the free ones that name the letter's
    place is taken, or none.

    Choices depend on which pages are free, so a letter chooses in the round
    in which it is the first on all pages that are left to it.  The result is
    that of the sequential choice; letters that share no page choose together,
    and rounds follow the longest chain of letters that share pages.
    """
    alive, done = settled(candidates.dropna(subset=["case_id", "day", "page_id"])), None
    wish = F.struct((-F.col("score")).alias("s"), "page_id")
    placed = F.coalesce(F.col("in_place"), F.lit(False))
    while alive.limit(1).count():
        first = alive.groupBy("page_id").agg(F.min(F.struct("day", "case_id")).alias("__first"))
        of = alive.join(first, "page_id").groupBy("case_id").agg(
            F.bool_and(F.col("__first.case_id") == F.col("case_id")).alias("ready"),
            F.count(F.lit(1)).alias("n"),
            F.min_by(F.struct("page_id", "name_ratio"), wish).alias("top"),
            F.min_by("page_id", F.when(placed, wish)).alias("named"),
        )
        by_name = (F.col("n") == 1) & (F.col("top.name_ratio") >= sure)
        chosen = of.filter("ready").select("case_id", F.when(by_name, F.col("top.page_id")).otherwise(F.col("named")).alias("page_id"), (~by_name).alias("by_place"))
        chosen = settled(chosen)
        done = chosen if done is None else done.unionByName(chosen)
        alive = settled(alive.join(chosen.select("case_id"), "case_id", "left_anti").join(chosen.select("page_id"), "page_id", "left_anti"))
    if done is None:
        return alive.select("case_id", "page_id", placed.alias("by_place"))
    return done.filter("page_id IS NOT NULL")


def find_pages(letters: DataFrame, pages: DataFrame, texts: DataFrame, days: int = 15, least: float = 80.0, sure: float = 90.0) -> DataFrame:
    """Candidates, the place that their texts name, and one page for each letter: (case_id, page_id, by_place).

    ``letters`` have besides their names a place: (state, state_code,
    aliases), NULL where unknown; ``texts``: (page_id, text), one row a page.
    A page without a text names no place.
    """
    met = page_candidates(letters, pages, days, least)
    place = letters.select("case_id", "state", "state_code", "aliases")
    read = met.join(place, "case_id").join(texts.select("page_id", "text"), "page_id", "left")
    named = mentions_place(F.coalesce("text", F.lit("")), F.col("state"), F.col("state_code"), F.col("aliases"))
    return one_page_each(read.withColumn("in_place", named).select(*met.columns, "in_place"), sure)
