"""Edit similarities of names as Columns (Spark has Levenshtein only).

The longest common subsequence is found by a fold over the letters of one
name; the state is a bit for each letter of the other, in words of 62 bits, so
that sums fit a bigint.  Lengths count code points, white space is Unicode's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 62
FULL = (1 << BITS) - 1


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once: an empty fold that only ends."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, then)


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def words(name: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(name, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(words(name)), " ")


def _letters(name: Column) -> Column:
    return F.filter(F.split(name, ""), lambda c: c != "")


def letter_masks(name: Column) -> Column:
    """Letter -> where it stands in the name, a bit each, in words of 62 (at least one word)."""

    def masks(letters: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(letters) - 1) / BITS).cast("int"))

        def places(letter: Column) -> Column:
            def word(w: Column) -> Column:
                part = F.slice(letters, w * BITS + 1, F.lit(BITS))
                bits = F.transform(part, lambda x, i: F.when(x == letter, F.call_function("shiftleft", _long(1), i)).otherwise(_long(0)))
                return F.aggregate(bits, _long(0), lambda all_, bit: all_.bitwiseOR(bit))

            return F.transform(starts, word)

        return _let(F.array_distinct(letters), lambda each: F.map_from_arrays(each, F.transform(each, places)))

    return _let(_letters(name), masks)


def common_length(masks: Column, n: Column, other: Column) -> Column:
    """Length of the longest common subsequence of a name, by its ``letter_masks`` and length, and another name."""
    letters = _letters(other)

    def step(state: Column, mask: Column) -> Column:
        hit = state.bitwiseAND(mask)
        return (state + hit).bitwiseAND(_long(FULL)).bitwiseOR(state - hit)

    short = F.aggregate(letters, _long(FULL), lambda state, c: step(state, F.coalesce(F.try_element_at(masks, c)[0], _long(0))))
    n_words = F.ceil(n / BITS).cast("int")

    def long_step(state: Column, c: Column) -> Column:
        def word(done: Column, at: Column) -> Column:
            hit = at["s"].bitwiseAND(at["m"])
            total = at["s"] + hit + done["carry"]
            new = total.bitwiseAND(_long(FULL)).bitwiseOR(at["s"] - hit)
            return F.struct(F.concat(done["out"], F.array(new)).alias("out"), F.shiftright(total, BITS).alias("carry"))

        none = F.struct(F.array().cast("array<bigint>").alias("out"), _long(0).alias("carry"))
        found = F.try_element_at(masks, c)
        at = F.zip_with(state, found, lambda s, m: F.struct(s.alias("s"), m.alias("m")))
        return F.when(found.isNull(), state).otherwise(F.aggregate(at, none, word, lambda done: done["out"]))

    long = F.aggregate(
        letters,
        F.array_repeat(_long(FULL), n_words),
        long_step,
        lambda state: F.aggregate(state, F.lit(0), lambda zeros, s: zeros + BITS - F.bit_count(s)),
    )
    return F.when(n <= BITS, BITS - F.bit_count(short)).otherwise(long)


def common_length_of(a: Column, b: Column) -> Column:
    return _let(letter_masks(a), lambda masks: common_length(masks, F.length(a), b))


def _ratio(common: Column, la: Column, lb: Column) -> Column:
    return F.when(la + lb == 0, 100.0).otherwise(F.try_divide(200.0 * common, la + lb))


def masked_ratio(masks: Column, n: Column, other: Column) -> Column:
    """``indel_ratio`` of a name whose masks and length are known, as where it meets many others."""
    return _ratio(common_length(masks, n, other), n, F.length(other))


def indel_ratio(a: Column, b: Column) -> Column:
    """Twice the common subsequence over both lengths, in percent; NULL if either name is."""
    return F.when(a.isNotNull() & b.isNotNull(), _ratio(common_length_of(a, b), F.length(a), F.length(b)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """``indel_ratio`` of the names with their words sorted."""
    both = F.struct(sorted_words(a).alias("a"), sorted_words(b).alias("b"))
    return _let(both, lambda s: indel_ratio(s["a"], s["b"]))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best agreement of the shared words with either side's words; NULL if either name is."""

    def apart(s: Column) -> Column:
        joined = lambda c: F.array_join(F.array_sort(c), " ")
        x, y = F.array_distinct(F.array_except(s["a"], s["b"])), F.array_distinct(F.array_except(s["b"], s["a"]))
        parts = F.struct(joined(F.array_intersect(s["a"], s["b"])).alias("both"), joined(x).alias("x"), joined(y).alias("y"))
        scored = _let(parts, score)
        return F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), 0.0).otherwise(scored)

    def score(p: Column) -> Column:
        shared, lx, ly = F.length(p["both"]), F.length(p["x"]), F.length(p["y"])
        gap = F.when(shared > 0, 1).otherwise(0)
        whole = lambda n: shared + gap + n
        rest = lx + ly - 2 * common_length_of(p["x"], p["y"])
        of_rest = 100.0 - F.try_divide(100.0 * rest, whole(lx) + whole(ly))
        of_shared = [100.0 - F.try_divide(100.0 * (gap + n), shared + whole(n)) for n in (lx, ly)]
        best = F.when(shared > 0, F.greatest(of_rest, *of_shared)).otherwise(of_rest)
        return F.when((shared > 0) & ((lx == 0) | (ly == 0)), 100.0).otherwise(best)

    both = F.struct(words(a).alias("a"), words(b).alias("b"))
    return F.when(a.isNotNull() & b.isNotNull(), _let(both, apart))


def name_score(a: Column, b: Column) -> Column:
    """Token-sorted similarity; where a name contains the other or they begin alike, up to 99 by their shared words."""

    def score(s: Column) -> Column:
        some = (F.size(s["a"]) > 0) & (F.size(s["b"]) > 0)
        within = (F.size(F.array_except(s["a"], s["b"])) == 0) | (F.size(F.array_except(s["b"], s["a"])) == 0)
        alike = some & (within | (F.get(s["a"], F.lit(0)) == F.get(s["b"], F.lit(0))))
        whole = token_sort_ratio(a, b)
        return F.when(alike, F.greatest(whole, F.least(F.lit(99.0), token_set_ratio(a, b)))).otherwise(whole)

    both = F.struct(words(a).alias("a"), words(b).alias("b"))
    return F.when(a == b, 100.0).when(a.isNotNull() & b.isNotNull(), _let(both, score))
