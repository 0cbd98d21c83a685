"""Run-time invariants of a pipeline; each raises with the rows that break it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class CheckFailed(AssertionError):
    """An invariant does not hold."""


def _none(rows: DataFrame, what: str) -> None:
    found = rows.limit(5).collect()  # a sample for the message
    if found:
        raise CheckFailed(f"{what}: {found}")


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    _none(rows.groupBy(*keys).count().filter("count > 1"), f"not unique in {keys}")
    return rows


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join after checking that the keys are unique on both sides."""
    return unique(left, keys).join(unique(right, keys), keys, how)


class Reconciliation:
    """Totals of a plan's branches, taken while it runs, and laws that must hold among them.

    ``watch`` puts a branch under observation, ``law`` names two sums over the
    totals that must be equal, and ``verify``, after the action, raises where
    they are not.  Nothing is scanned a second time, unless a law is broken:
    a stage that runs again after a lost executor may be counted twice, so the
    branches of a broken law are counted anew before it raises.
    """

    def __init__(self) -> None:
        self._watched: dict[str, tuple[DataFrame, dict[str, Column], Observation]] = {}
        self._laws: list[tuple[str, Callable[[dict], int], Callable[[dict], int]]] = []

    def watch(self, rows: DataFrame, branch: str, **totals: Column) -> DataFrame:
        """The rows; their totals become known by an action over them. Totals over no rows are zero."""
        if branch in self._watched:
            raise ValueError(f"{branch} is watched already")
        whole = {name: F.coalesce(c, F.lit(0)) for name, c in totals.items()}
        taken = Observation(branch)
        self._watched[branch] = rows, whole, taken
        return rows.observe(taken, *[c.alias(name) for name, c in whole.items()])

    def law(self, what: str, left: Callable[[dict], int], right: Callable[[dict], int]) -> None:
        self._laws.append((what, left, right))

    def totals(self, anew: bool = False) -> dict[str, dict]:
        """By branch; waits for the first action over them. A branch that the plan left out, as a side of it was empty, is counted."""
        return {branch: self._counted(rows, whole) if anew else self._observed(branch) for branch, (rows, whole, _) in self._watched.items()}

    def _observed(self, branch: str) -> dict:
        rows, whole, taken = self._watched[branch]
        try:
            return dict(taken.get)
        except Py4JJavaError:  # no totals came
            return self._counted(rows, whole)

    @staticmethod
    def _counted(rows: DataFrame, whole: dict[str, Column]) -> dict:
        return rows.agg(*[c.alias(n) for n, c in whole.items()]).first().asDict()

    def verify(self) -> dict[str, dict]:
        """The totals, if all laws hold."""
        found = self.totals()
        if all(left(found) == right(found) for _, left, right in self._laws):
            return found
        found = self.totals(anew=True)
        for what, left, right in self._laws:
            if left(found) != right(found):
                raise CheckFailed(f"{what}: {left(found)} and {right(found)} of {found}")
        return found


def conserved(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    total = lambda df: df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]
    if (a := total(before)) != (b := total(after)):
        raise CheckFailed(f"sum of {column} went from {a} to {b}")
    return after


def ordered(rows: DataFrame, earlier: str, later: str) -> DataFrame:
    _none(rows.filter(F.col(earlier) > F.col(later)), f"{earlier} after {later}")
    return rows


def at_least(rows: DataFrame, floor: int, what: str = "rows") -> DataFrame:
    if (n := rows.count()) < floor:
        raise CheckFailed(f"{n} {what}, expected {floor} at least; the source may be truncated")
    return rows


def domain(rows: DataFrame, column: str, allowed: list) -> DataFrame:
    _none(rows.filter(~F.col(column).isin(*allowed)).select(column).distinct(), f"{column} outside {allowed}")
    return rows


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join; the rows in which a value differs or one side is missing."""
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    differs: Column = reduce(lambda x, y: x | y, [~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values])
    picked = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    sides = [F.col(f"{s}.{v}").alias(f"{side}_{v}") for v in values for s, side in (("a", "left"), ("b", "right"))]
    return a.join(b, same, "full_outer").filter(differs).select(*picked, *sides)
