"""Entity resolution: lookups that refuse ambiguity, precedence, prefixes, curated maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.names import entity_family, normalize_name
from ledgerloom.functions.similarity import letter_masks, masked_ratio, sorted_words

from .temporal import drop_conflicts

SAFE_CHARS = 5


def name_candidates(master: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(name_key, key) of every non-empty normalized name of a firm."""
    parts = [master.select(normalize_name(F.col(n)).alias("name_key"), key) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("name_key <> ''").distinct()


def unique_lookup(candidates: DataFrame, name: str, key: str) -> DataFrame:
    """name, n_candidates and the key where there is one candidate only."""
    found = candidates.filter(F.col(name).isNotNull()).groupBy(name)
    out = found.agg(F.countDistinct(key).alias("n_candidates"), F.min(key).alias("__key"))
    return out.select(name, "n_candidates", F.when(F.col("n_candidates") == 1, F.col("__key")).alias(key))


def match_names(rows: DataFrame, lookup: DataFrame, name: str, key: str, raw: str | None = None, matched_name: str | None = None) -> DataFrame:
    """Left join with match_status matched / ambiguous / unmatched, and review where the corporate families differ."""
    joined = rows.join(lookup, name, "left")
    status = F.when(F.col("n_candidates").isNull(), "unmatched").when(F.col("n_candidates") > 1, "ambiguous").otherwise("matched")
    out = joined.withColumn("match_status", status).withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    if raw and matched_name:
        mine, theirs = entity_family(F.col(raw)), entity_family(F.col(matched_name))
        differ = (mine != theirs) & (mine != "none") & (theirs != "none")
        out = out.withColumn("review_suggested", (F.col("match_status") == "matched") & differ)
    return out


def industry_gate(sic: Column, ranges: tuple[tuple[int, int], ...] = ((2833, 2836), (3841, 3845))) -> Column:
    number = sic.try_cast("int")
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | number.between(low, high)
    return F.coalesce(inside, F.lit(False))


def match_with_gate(rows: DataFrame, lookup: DataFrame, name: str, key: str, sic: DataFrame) -> DataFrame:
    """As match_names, with too_short names and out_of_industry firms told apart.  ``sic``: (key, sic)."""
    joined = match_names(rows, lookup, name, key).join(sic, key, "left")
    status = (
        F.when(F.length(F.coalesce(F.col(name), F.lit(""))) < SAFE_CHARS, "too_short")
        .when(F.col("match_status") != "matched", F.col("match_status"))
        .when(~industry_gate(F.col("sic")), "out_of_industry")
        .otherwise("matched")
    )
    return joined.withColumn("match_status", status)


def most_trusted(sources: dict[str, DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union of sources; for each key only the row of the most trusted source (in the order given), ties by ``order``."""
    out = None
    for rank, (source, df) in enumerate(sources.items()):
        part = df.withColumns({"match_source": F.lit(source), "__rank": F.lit(rank)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    first = Window.partitionBy(*keys).orderBy("__rank", *order)
    return out.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn", "__rank")


def suppress(rows: DataFrame, trusted: DataFrame, key: str) -> DataFrame:
    """Trusted rows, and the others of keys that have none."""
    return trusted.unionByName(rows.join(trusted.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


#: Most to least trusted sources of curated links.
CURATED_ORDER = ("project_override_windowed", "ct_override_windowed", "ct_override", "ct_resolved", "ct_dropped_device", "ct_fuzzy")
WINDOWED = CURATED_ORDER[:2]


def curated_map(sources: dict[str, DataFrame], name: str = "name_key", key: str = "gvkey", low: str = "valid_from", high: str = "valid_to") -> DataFrame:
    """Resolve curated links: trust order per (name, window), project rows alone where there are any,
    windowed rows alone where there are any, and no name whose windows conflict."""
    best = most_trusted({s: sources[s] for s in CURATED_ORDER if s in sources}, [name, low, high], [key])
    best = best.filter(F.col(name).isNotNull() & (F.col(name) != ""))
    per_name = Window.partitionBy(name)
    project = F.max((F.col("match_source") == CURATED_ORDER[0]).cast("int")).over(per_name)
    windowed = F.max(F.col("match_source").isin(*WINDOWED).cast("int")).over(per_name)
    marked = best.withColumns({"__project": project, "__windowed": windowed})
    stay = F.when(F.col("__project") == 1, F.col("match_source") == CURATED_ORDER[0]).otherwise(
        (F.col("__windowed") == 0) | F.col("match_source").isin(*WINDOWED)
    )
    return drop_conflicts(marked.filter(stay).drop("__project", "__windowed"), name, key, low, high)


def backfill(exact: DataFrame, curated: DataFrame, recipients: DataFrame, parents: DataFrame, name: str = "name_key", key: str = "gvkey") -> DataFrame:
    """Exact matches not replaced by windowed links, curated links of the rest, then the longest parent prefix.

    A curated key 'UNMAPPED' resolves the name without a key.
    """
    windowed = curated.filter(F.col("match_source").isin(*WINDOWED)).select(name).distinct()
    kept = exact.join(windowed, name, "left_anti").withColumn("match_source", F.lit("exact_normalized"))
    rest = recipients.select(name).distinct().join(kept.select(name), name, "left_anti")
    linked = rest.join(curated, name)
    status = F.when(F.col(key) == "UNMAPPED", "resolved_unlisted_parent").otherwise("matched")
    linked = linked.withColumn("match_status", status).withColumn(key, F.when(F.col(key) != "UNMAPPED", F.col(key)))
    still = rest.join(linked.select(name).distinct(), name, "left_anti")
    prefixed = longest_prefix(still, parents, name, key, least_chars=8, least_tokens=2, strict=True).filter(F.col(key).isNotNull())
    prefixed = prefixed.withColumns({"match_source": F.lit("parent_prefix"), "match_status": F.lit("matched")})
    out = kept.withColumn("match_status", F.lit("matched"))
    return out.unionByName(linked, allowMissingColumns=True).unionByName(prefixed, allowMissingColumns=True)


def token_prefixes(name: Column, least_tokens: int, strict: bool) -> Column:
    """Prefixes of a name that end at a token, shortest first."""
    tokens = F.split(name, " ")
    most = F.size(tokens) - (1 if strict else 0)
    made = F.transform(F.sequence(F.lit(least_tokens), most), lambda n: F.array_join(F.slice(tokens, 1, n), " "))
    return F.when(most >= least_tokens, made).otherwise(F.array().cast("array<string>"))


def longest_prefix(rows: DataFrame, index: DataFrame, name: str, key: str, least_chars: int = 6, least_tokens: int = 1, strict: bool = True, row_id: str | None = None) -> DataFrame:
    """Left join of names to the longest indexed name that they extend at a token boundary.

    An equi-join on generated prefixes instead of a nested loop; resolved once for each distinct name.  Rows that
    are unique in ``row_id`` are resolved one by one instead and read once only, which is less where they are dear.
    """
    if row_id is not None:
        return _longest_prefix_once(rows.drop(key), index, name, key, least_chars, least_tokens, strict, row_id)
    names = rows.select(name).filter(F.col(name).isNotNull()).distinct()
    made = names.select(name, F.explode(token_prefixes(F.col(name), least_tokens, strict)).alias("__prefix"))
    made = made.filter(F.length("__prefix") >= least_chars)
    parents = index.select(F.col(name).alias("__prefix"), F.col(key)).distinct()
    best = made.join(parents, "__prefix").groupBy(name).agg(F.max_by(F.struct("__prefix", key), F.struct(F.length("__prefix"), key)).alias("__b"))
    best = best.select(name, F.col("__b")["__prefix"].alias("matched_prefix"), F.col("__b")[key].alias(key))
    return rows.drop(key).join(best, name, "left") if key in rows.columns else rows.join(best, name, "left")


def _longest_prefix_once(rows: DataFrame, index: DataFrame, name: str, key: str, least_chars: int, least_tokens: int, strict: bool, row_id: str) -> DataFrame:
    long = F.filter(token_prefixes(F.col(name), least_tokens, strict), lambda p: F.length(p) >= least_chars)
    made = rows.withColumn("__made", long).withColumn("__any", F.size("__made") > 0)
    # A name without prefixes goes under itself and meets nothing, so that all such names are no single task.
    made = made.withColumn("__prefix", F.explode(F.when(F.col("__any"), F.col("__made")).otherwise(F.array(name)))).drop("__made").alias("m")
    parents = index.select(F.col(name).alias("__prefix"), F.col(key)).distinct().alias("p")
    hit = made.join(parents, (F.col("m.__prefix") == F.col("p.__prefix")) & F.col("__any"), "left")
    longest = F.when(F.col("p.__prefix").isNotNull(), F.struct(F.length("p.__prefix"), key))
    found = F.max_by(F.struct(F.col("p.__prefix").alias("matched_prefix"), F.col(key)), longest).alias("__b")
    best = hit.groupBy(row_id).agg(F.any_value(F.struct(*rows.columns)).alias("__row"), found)
    return best.select(*[F.col("__row")[c].alias(c) for c in rows.columns], "__b.matched_prefix", F.col("__b")[key].alias(key))


def resolve_tiers(rows: DataFrame, exact: DataFrame, index: DataFrame, name: str, key: str, row_id: str | None = None) -> DataFrame:
    """Tier A_exact, else B_prefix (keys of six characters or more), with link_tier; ``row_id`` as in ``longest_prefix``."""
    hit = exact.select(name, F.col(key).alias("__exact"))
    both = longest_prefix(rows, index, name, key, row_id=row_id).join(hit, name, "left")
    tier = F.when(F.col("__exact").isNotNull(), "A_exact").when(F.col(key).isNotNull(), "B_prefix")
    return both.withColumns({"link_tier": tier, key: F.coalesce("__exact", key)}).drop("__exact")


def first_hit(rows: DataFrame, elements: str, index: DataFrame, name: str, key: str, row_id: str) -> DataFrame:
    """Left join to the first array element that the index knows, with its position (from 0)."""
    each = rows.select(row_id, F.posexplode(elements).alias("hit_pos", name))
    best = each.join(index.select(name, key), name).groupBy(row_id).agg(F.min_by(F.struct("hit_pos", name, key), "hit_pos").alias("__b"))
    return rows.join(best.select(row_id, "__b.*"), row_id, "left")


def similar_names(left: DataFrame, right: DataFrame, name: str, right_name: str, cutoff: float = 90.0, by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of distinct names whose token-sorted similarity reaches the cutoff, with it.

    With ``by`` only those that stand together under one key of these columns
    at least; the pair is still one row.

    Candidates have lengths that allow the cutoff and share a piece, which no
    pair at the cutoff escapes: lengths ``la`` and ``lb`` allow ``e`` letters
    dropped or added at most, of even or odd number as ``la + lb`` is, so of
    ``e + 1`` pieces of the left name one stands whole in the match.  The first
    piece ``i`` with no more than ``i`` edits up to its end has none itself,
    ``i`` before it and ``e - i`` at most after it, which bounds its place and
    makes its shift even or odd as ``i`` is.  Keys are made only for lengths
    that the other side has; each pair of lengths has the longest pieces that
    it allows, so few names meet by chance.  Under a cutoff of two thirds
    pieces may be empty and tell nothing, so all names are scored.
    """

    def by_tokens(df: DataFrame, column: str) -> DataFrame:
        known = df.select(*by, column).filter(F.col(column).isNotNull()).distinct()
        return known.withColumn("__s", sorted_words(F.col(column))).withColumn("__n", F.length("__s"))

    def lengths(df: DataFrame, column: str) -> DataFrame:
        """One row: the lengths of names, as many as there are different ones."""
        known = df.filter(F.col(column).isNotNull())
        return F.broadcast(known.agg(F.sort_array(F.collect_set(F.length(sorted_words(F.col(column))))).alias("__lengths")))

    def whole(c: Column) -> Column:
        return F.floor(c + 1e-6).cast("int")  # rounding may add candidates, never lose one

    def edits(la: Column, lb: Column) -> Column:
        most = whole((la + lb) * (1 - cutoff / 100))
        return most - (most + la + lb) % 2

    def start(la: Column, e: Column, i: Column) -> Column:
        return F.floor(i * la / (e + 1)).cast("int")

    def key(la: Column, lb: Column, e: Column, i: Column, at: Column) -> Column:
        return F.struct(la.alias("la"), lb.alias("lb"), i.alias("i"), F.substr("__s", at + 1, start(la, e, i + 1) - start(la, e, i)).alias("piece"))

    def places(la: Column, lb: Column, e: Column, i: Column) -> Column:
        """Where in a name of length lb the i-th piece of a name of length la can be."""
        apart, after = lb - la, e - i
        low = F.greatest(-i, apart - after, F.floor((apart - e) / 2).cast("int"), -start(la, e, i))
        high = F.least(i, apart + after, F.floor((e + apart) / 2).cast("int"), lb - start(la, e, i + 1))
        first = low + F.pmod(low - i, F.lit(2))
        return F.when(first <= high, F.transform(F.sequence(first, high, F.lit(2)), lambda x: start(la, e, i) + x)).otherwise(F.array().cast("array<int>"))

    def keys(of_lengths, of_piece) -> Column:
        """Keys of all lengths of the other side that allow the cutoff, of all pieces."""

        def of_pair(other: Column) -> Column:
            la, lb = of_lengths(other)
            e = edits(la, lb)
            numbers = F.when(e >= F.abs(la - lb), F.sequence(F.lit(0), e)).otherwise(F.array().cast("array<int>"))
            return F.flatten(F.transform(numbers, lambda i: of_piece(la, lb, e, i)))

        return F.explode(F.array_distinct(F.flatten(F.transform("__lengths", of_pair))))

    if 3 * cutoff <= 200:
        b = by_tokens(right, right_name).select(*by, right_name, F.col("__s").alias("__t"))
        a = by_tokens(left, name).select(*by, name)
        pairs = a.join(b, list(by)).select(name, right_name, "__t").distinct() if by else a.crossJoin(b)
    else:
        n = F.col("__n")
        a = by_tokens(left, name).crossJoin(lengths(right, right_name))
        a = a.withColumn("__key", keys(lambda lb: (n, lb), lambda la, lb, e, i: F.array(key(la, lb, e, i, start(la, e, i)))))
        b = by_tokens(right, right_name).crossJoin(lengths(left, name))
        b = b.withColumn("__key", keys(lambda la: (la, n), lambda la, lb, e, i: F.transform(places(la, lb, e, i), lambda at: key(la, lb, e, i, at))))
        b = b.select(*by, right_name, F.col("__s").alias("__t"), "__key")
        pairs = a.select(*by, name, "__key").join(b, [*by, "__key"]).select(name, right_name, "__t").distinct()
    # Masks are made once a left name, and pairs meet them by it.
    known = by_tokens(left, name).select(name, "__s", "__n")
    known = (known.distinct() if by else known).select(name, "__n", letter_masks(F.col("__s")).alias("__masks"))
    scored = pairs.join(known, name).withColumn("similarity", masked_ratio(F.col("__masks"), F.col("__n"), F.col("__t")))
    return scored.filter(F.col("similarity") >= cutoff).select(name, right_name, "similarity")


def fuzzy_top1(left: DataFrame, right: DataFrame, name: str, right_name: str, cutoff: float = 90.0) -> DataFrame:
    """The most similar right name of each left name, by token-sorted similarity, if it reaches the cutoff.

    The least name wins ties.
    """
    kept = similar_names(left, right, name, right_name, cutoff)
    best = kept.groupBy(name).agg(F.min_by(F.struct(right_name, "similarity"), F.struct(-F.col("similarity"), F.col(right_name))).alias("__b"))
    return best.select(name, "__b.*")


def keys_by_like(keys: DataFrame, master: DataFrame, key: str, name: str, probe: str, piece: int = 3) -> DataFrame:
    """Keys found by padded equality; those not found, by a name that contains their probe, in any case.

    A name that contains a probe contains its first ``piece`` characters: names and probes meet by these, and the
    containment is verified.  Probes shorter than that meet by all of theirs.
    """
    equal = keys.join(master, key)
    missing = keys.join(equal.select(key), key, "left_anti").withColumn("__p", F.upper(probe)).filter("__p <> ''")
    k = missing.withColumn("__piece", F.substring("__p", 1, piece)).alias("k")

    def pieces(text: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
        return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.substr(text, i, F.lit(n)) for n in range(1, piece + 1)]))))

    m = master.withColumn("__u", F.upper(name)).withColumn("__piece", F.explode(pieces(F.col("__u")))).alias("m")
    like = k.join(m, (F.col("k.__piece") == F.col("m.__piece")) & F.contains(F.col("m.__u"), F.col("k.__p")))
    return equal.select(key, probe, name).unionByName(like.select(F.col(f"m.{key}").alias(key), f"k.{probe}", f"m.{name}"))
